"""Behavioural feature operators over (sessions, ticks, incidents).

Plan shape shared by all of them: the scope filter runs on ``sessions``; ticks
and incidents are restricted with a left-semi join on ``match_id`` (the
exchange it needs is the same hash partitioning every later per-session
window/aggregate uses, so a whole feature costs one shuffle of ticks); the
per-tick baselines are aggregates over the small tick domain (partial
aggregation, then a broadcast of at most one row per tick value); global means
are one-row aggregates joined as scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playline.config import DEFAULT, AnalysisConfig
from playline.functions.scalars import below_band, off_corridor, time_bucket, ts_literal
from playline.operators.sequence import gap_flags, nearest_anchor, rolling_prior_mean, run_by_bucket

KEY, TICK = "match_id", "timestamp_min"


# ---------------------------------------------------------------- P1 -------
def scope(sessions: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Analysis scope: start at/after the season boundary and the analysed role."""
    return sessions.where((F.col("game_datetime") >= ts_literal(sessions, "game_datetime", cfg.season_start))
                          & (F.col("team_position") == F.lit(cfg.role)))


def in_scope(rows: DataFrame, scoped: DataFrame) -> DataFrame:
    """Rows (ticks/incidents) of scoped sessions: left-semi join on the key."""
    return rows.join(scoped.select(KEY), KEY, "left_semi")


# ---------------------------------------------------------------- A1/A2 ----
def baseline_by_tick(ticks: DataFrame, value: str, low: int | None = None, high: int | None = None,
                     with_std: bool = False) -> DataFrame:
    """Mean (and sample std) of ``value`` per tick; one row per tick value."""
    t = ticks
    if low is not None:
        t = t.where(F.col(TICK).between(low, high))
    aggs = [F.avg(value).alias(f"avg_{value}")]
    if with_std:
        aggs.append(F.stddev_samp(value).alias(f"std_{value}"))
    return t.groupBy(TICK).agg(*aggs)


def tick_baselines(scoped_ticks: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Both per-tick baselines in one aggregate over the scoped ticks: mean
    gold over all ticks (incident context) and mean / sample std of cs over the
    phase ticks (excursion fallback). One row per tick value."""
    phase = F.col(TICK).between(cfg.phase_start, cfg.phase_end)
    return scoped_ticks.groupBy(TICK).agg(
        F.avg("gold").alias("avg_gold"),
        F.avg(F.when(phase, F.col("cs"))).alias("avg_cs"),
        F.stddev_samp(F.when(phase, F.col("cs"))).alias("std_cs"))


def anchors(scoped_ticks: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """W4 on gold: one row per scoped session that has a tick in the anchor window."""
    return nearest_anchor(scoped_ticks, KEY, TICK, "gold", cfg.anchor_tick, cfg.anchor_low,
                          cfg.anchor_high, out="anchor_gold", out_tick="anchor_tick")


# ---------------------------------------------------------------- D2 -------
def mean_anchor(anchor_rows: DataFrame):
    """Mean anchor gold as a scalar subquery, evaluated once."""
    return anchor_rows.agg(F.avg("anchor_gold")).scalar()


def swing_columns(mean, cfg: AnalysisConfig):
    """(gold_delta, is_throw, is_comeback) of a row with win and anchor_gold; thresholds are inclusive."""
    d, thr = F.col("anchor_gold") - mean, cfg.swing_threshold
    return (d.alias("gold_delta"), ((d >= thr) & ~F.col("win")).alias("is_throw"),
            ((d <= -thr) & F.col("win")).alias("is_comeback"))


def swing_games(sessions: DataFrame, ticks: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Throw / comeback classification from the anchor-tick gold delta.

    Columns: match_id, gold_at_14, gold_delta, is_throw, is_comeback (+ win).
    Sessions without an anchor tick drop out."""
    sc = scope(sessions, cfg)
    both = sc.select(KEY, "win").join(anchors(in_scope(ticks, sc), cfg), KEY)
    return both.select(KEY, "win", F.col("anchor_gold").alias("gold_at_14"), *swing_columns(mean_anchor(both), cfg))


# ---------------------------------------------------------------- D1 -------
def incident_context(sessions: DataFrame, ticks: DataFrame, incidents: DataFrame,
                     cfg: AnalysisConfig = DEFAULT, missing: str = "zero",
                     baselines: DataFrame | None = None, anchor_rows: DataFrame | None = None, mean=None) -> DataFrame:
    """Per-incident context flags.

    ``missing="zero"`` treats an unknown snapshot as 0 gold (parity with the
    analysed application); ``"unknown"`` keeps the lead and its two lead flags NULL.
    ``baselines`` / ``anchor_rows`` / ``mean`` let a caller share those computations.
    """
    sc = scope(sessions, cfg)
    st = in_scope(ticks, sc)
    si = in_scope(incidents, sc)
    base = (baselines if baselines is not None else baseline_by_tick(st, "gold")).select(TICK, "avg_gold")
    a = anchor_rows if anchor_rows is not None else anchors(st, cfg)
    mean = mean_anchor(a) if mean is None else mean
    if missing == "zero":
        lead = F.coalesce(F.col("gold_at_death"), F.lit(0)) - F.coalesce(F.col("avg_gold"), F.lit(0.0))
    elif missing == "unknown":
        lead = F.col("gold_at_death") - F.col("avg_gold")
    else:
        raise ValueError("missing must be 'zero' or 'unknown'")
    thr, t = cfg.swing_threshold, F.col(TICK)
    df = (si.join(base, TICK, "left")
          .join(a.select(KEY, "anchor_gold"), KEY, "left")
          .withColumn("gold_lead_approx", lead.cast("double"))
          .transform(lambda d: gap_flags(d, KEY, "death_number", TICK, cfg.spiral_gap, out="_spiral",
                                         seq="death_number")))
    return df.select(
        KEY, "death_number", TICK, "gold_at_death", "gold_lead_approx",
        ((F.col("gold_lead_approx") > thr) & (t <= cfg.laning_end)).alias("is_overextension_ahead"),
        ((F.col("gold_lead_approx") < -thr) & (t <= cfg.laning_end)).alias("is_deficit_fight"),
        (t < cfg.early_tick).alias("is_early_death"),
        F.col("_spiral").alias("is_tilt_spiral"),
        F.coalesce((t > cfg.laning_end) & (F.col("anchor_gold") > mean + thr),
                   F.lit(False)).alias("is_post_laning_throw"))


# ---------------------------------------------------------------- D3 -------
def excursions(sessions: DataFrame, ticks: DataFrame, cfg: AnalysisConfig = DEFAULT,
               std_mult: float | None = None, min_rows: int | None = None,
               baselines: DataFrame | None = None) -> DataFrame:
    """Excursion windows inside the phase ticks, with their cost and kill impact.

    Mode per session: position mode if any phase tick has ``position_x``
    (corridor test), otherwise CS-drop mode (cs below the per-tick scoped mean
    minus ``std_mult`` sample std). Runs are over rows present (a missing tick
    does not break a run) and need ``min_rows`` rows. Offsets at start-1 and
    end+1 are read with lag/lead over the loaded ticks and only used when the
    neighbour is exactly one tick away.
    """
    sc = scope(sessions, cfg)
    loaded = in_scope(ticks.where(F.col(TICK).between(cfg.load_start, cfg.load_end)), sc)
    base = (baselines.select(TICK, "avg_cs", "std_cs") if baselines is not None
            else baseline_by_tick(loaded, "cs", cfg.phase_start, cfg.phase_end, with_std=True))
    return excursion_costs(excursion_runs(loaded, base, cfg, std_mult, min_rows), mean_rate(sc))


def mean_rate(scoped: DataFrame):
    """Mean cs per minute of the scope as a scalar subquery, 0 without sessions."""
    return scoped.agg(F.coalesce(F.avg("cs_per_min"), F.lit(0.0))).scalar()


def excursion_runs(loaded: DataFrame, base: DataFrame, cfg: AnalysisConfig = DEFAULT,
                   std_mult: float | None = None, min_rows: int | None = None) -> DataFrame:
    """The excursions among loaded ticks, before costs. ``base``: avg_cs and
    std_cs per tick, which only sessions in CS-drop mode look at."""
    std_mult = cfg.std_mult if std_mult is None else std_mult
    min_rows = cfg.min_excursion_rows if min_rows is None else min_rows
    w = Window.partitionBy(KEY).orderBy(TICK)
    t = F.col(TICK)
    nb = (loaded
          .withColumn("_p_tick", F.lag(TICK).over(w)).withColumn("_p_cs", F.lag("cs").over(w))
          .withColumn("_p_kills", F.lag("kills").over(w))
          .withColumn("_n_tick", F.lead(TICK).over(w)).withColumn("_n_cs", F.lead("cs").over(w))
          .where(t.between(cfg.phase_start, cfg.phase_end)))
    pos_mode = F.max(F.col("position_x").isNotNull()).over(Window.partitionBy(KEY))
    corridor = off_corridor("position_x", "position_y", cfg.corridor_width)
    drop = below_band("cs", "avg_cs", "std_cs", std_mult)
    flagged = (nb.join(base, TICK, "left")
               .withColumn("_roam", F.when(pos_mode, corridor).otherwise(drop)))
    prev_flag = F.lag("_roam").over(w)
    opens = F.when(prev_flag.isNull() | (prev_flag != F.col("_roam")), 1).otherwise(0)
    blocks = flagged.withColumn("_blk", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    before_cs = F.when(F.col("_p_tick") == t - 1, F.col("_p_cs")).otherwise(F.lit(0))
    before_k = F.when(F.col("_p_tick") == t - 1, F.col("_p_kills")).otherwise(F.lit(0))
    after_cs = F.when(F.col("_n_tick") == t + 1, F.col("_n_cs")).otherwise(F.col("cs"))
    return (blocks.where("_roam").groupBy(KEY, "_blk").agg(
        F.min(TICK).alias("roam_start_min"), F.max(TICK).alias("roam_end_min"),
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(before_cs, t).alias("cs_before"), F.min_by(before_k, t).alias("_k_pre"),
        F.max_by(after_cs, t).alias("cs_after"), F.max_by(F.col("kills"), t).alias("_k_end"))
        .where(F.col("_rows") >= min_rows))


def excursion_costs(runs: DataFrame, rate) -> DataFrame:
    """Costs and result of excursions at ``rate`` expected cs per tick."""
    dur = F.col("roam_end_min") - F.col("roam_start_min") + 1
    kills = F.greatest(F.col("_k_end") - F.col("_k_pre"), F.lit(0))
    return (runs
            .withColumn("expected_cs_delta", (dur * rate).cast("double"))
            .select(KEY, "roam_start_min", "roam_end_min", F.col("cs_before").cast("int").alias("cs_before"),
                    F.col("cs_after").cast("int").alias("cs_after"), "expected_cs_delta",
                    F.greatest(F.col("expected_cs_delta") - (F.col("cs_after") - F.col("cs_before")),
                               F.lit(0.0)).alias("cs_sacrifice"),
                    kills.cast("int").alias("kills_during_roam"),
                    F.when(kills > 0, F.lit("impact")).otherwise(F.lit("no_impact")).alias("roam_result")))


# ---------------------------------------------------------------- D4 -------
def rival_matchups(sessions: DataFrame, cfg: AnalysisConfig = DEFAULT, min_games: int | None = None) -> DataFrame:
    """Per (own, rival) pair: games, mean cs both sides, cs_diff, win rate, KDA both sides.

    A grouped aggregate with partial aggregation: a hot pair only costs one
    partial row per map task.
    """
    min_games = cfg.min_rival_games if min_games is None else min_games
    sc = scope(sessions, cfg).where(F.col("opp_champion_name").isNotNull() & F.col("opp_cs_total").isNotNull())
    opp_kda = F.when(F.col("opp_deaths").isNotNull(),
                     (F.col("opp_kills") + F.col("opp_assists")) / F.greatest(F.col("opp_deaths"), F.lit(1)))
    g = sc.groupBy("champion_name", "opp_champion_name").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg("cs_total").alias("our_avg_cs"), F.avg("opp_cs_total").alias("opp_avg_cs"),
        F.avg(F.col("win").cast("double")).alias("our_winrate"),
        F.avg("kda").alias("our_avg_kda"), F.avg(opp_kda).alias("opp_avg_kda"))
    return (g.where(F.col("games") >= min_games)
            .select("champion_name", "opp_champion_name", "games", "our_avg_cs", "opp_avg_cs",
                    (F.col("our_avg_cs") - F.col("opp_avg_cs")).alias("cs_diff"),
                    "our_winrate", "our_avg_kda", "opp_avg_kda"))


# ---------------------------------------------------------------- D5 -------
def rolling_form(sessions: DataFrame, cfg: AnalysisConfig = DEFAULT, entity: str = "puuid") -> DataFrame:
    """Prior-N win rate per entity (the tilt proxy); first session -> neutral.

    Columns: match_id, puuid, game_datetime, win, tilt_index, game_number (1.. per entity).
    """
    sc = scope(sessions, cfg).select(KEY, entity, "game_datetime", "win")
    out = rolling_prior_mean(sc, [entity], ["game_datetime", KEY], "win", n=cfg.rolling_window,
                             neutral=cfg.neutral_form, out="tilt_index", seq_out="game_number")
    return out.select(KEY, entity, "game_datetime", "win", "tilt_index", "game_number")


# ------------------------------------------------------------- A5/A6/A7 ----
def incident_agg(ctx: DataFrame) -> DataFrame:
    """Per session: total incidents, incidents while ahead, spiral ratio (bround 4), max streak.

    One pass over the incidents, bucket by bucket, then one row per bucket."""
    parts = run_by_bucket(ctx, KEY, "death_number", "is_tilt_spiral", extra=(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("is_overextension_ahead").cast("int")).alias("_ahead"),
        F.sum(F.col("is_tilt_spiral").cast("int")).alias("_spirals")))
    per = parts.groupBy(KEY).agg(F.sum("_n").cast("int").alias("total_deaths"),
                                 F.sum("_ahead").cast("int").alias("deaths_while_ahead"),
                                 F.sum("_spirals").alias("_spirals"), F.max("_run").cast("int").alias("_run"))
    ratio = F.bround(F.col("_spirals") / F.greatest(F.col("total_deaths"), F.lit(1)), 4)
    return per.select(KEY, "total_deaths", "deaths_while_ahead", ratio.alias("tilt_spiral_ratio"),
                      F.coalesce("_run", F.lit(0)).alias("max_death_streak"))


def excursion_agg(ex: DataFrame) -> DataFrame:
    return ex.groupBy(KEY).agg(
        F.count(F.lit(1)).cast("int").alias("total_roams"),
        F.avg("cs_sacrifice").alias("avg_cs_sacrifice"),
        F.avg((F.col("roam_result") == "impact").cast("double")).alias("roam_impact_rate"))


def temporal_columns(ts: str):
    t = F.col(ts)
    dow = F.weekday(t)
    return (F.hour(t).alias("hour_of_day"), dow.alias("day_of_week"), dow.isin(5, 6).alias("is_weekend"),
            time_bucket(F.hour(t)).alias("time_bucket"))


def temporal(scoped: DataFrame) -> DataFrame:
    return scoped.select(KEY, *temporal_columns("game_datetime"))


# ---------------------------------------------------------------- D6 -------
def feature_matrix(sessions: DataFrame, ticks: DataFrame, incidents: DataFrame,
                   cfg: AnalysisConfig = DEFAULT, baselines: DataFrame | None = None) -> DataFrame:
    """One NULL-free row per scoped session (19 columns, contract order).

    ``baselines``: the result of ``tick_baselines`` where it is stored already."""
    sc = scope(sessions, cfg)
    st = in_scope(ticks, sc)
    base = tick_baselines(st, cfg) if baselines is None else baselines        # one aggregate for both baselines
    a = anchors(st, cfg)                  # one anchor pass and one mean for swings and incident context
    mean = mean_anchor(a)
    inc = incident_agg(incident_context(sessions, ticks, incidents, cfg, baselines=base, anchor_rows=a, mean=mean))
    exc = excursion_agg(excursions(sessions, ticks, cfg, baselines=base))
    # the session's own columns ride along with its form, so the scope is not read again
    form = rolling_prior_mean(sc.select(KEY, "puuid", "game_datetime", "win", "champion_name"), ["puuid"],
                              ["game_datetime", KEY], "win", n=cfg.rolling_window, neutral=cfg.neutral_form, out="tilt_index")
    fm = (form.select(KEY, "win", "game_datetime", "champion_name", "tilt_index", *temporal_columns("game_datetime"))
          .join(a.select(KEY, "anchor_gold"), KEY, "left").withColumns(
              {c: x for c, x in zip(("gold_delta", "is_throw", "is_comeback"), swing_columns(mean, cfg))})
          .join(inc, KEY, "left").join(exc, KEY, "left"))
    return matrix_columns(fm)


def matrix_columns(fm: DataFrame) -> DataFrame:
    """F16: the fill policy and the contract's column order."""
    return fm.select(
        KEY, "win", "game_datetime", "champion_name", "tilt_index",
        "hour_of_day", "day_of_week", "is_weekend", "time_bucket",
        F.coalesce("is_throw", F.lit(False)).alias("is_throw"),
        F.coalesce("is_comeback", F.lit(False)).alias("is_comeback"),
        F.coalesce("gold_delta", F.lit(0.0)).alias("gold_delta"),
        F.coalesce("total_deaths", F.lit(0)).alias("total_deaths"),
        F.coalesce("deaths_while_ahead", F.lit(0)).alias("deaths_while_ahead"),
        F.coalesce("tilt_spiral_ratio", F.lit(0.0)).cast("double").alias("tilt_spiral_ratio"),
        F.coalesce("max_death_streak", F.lit(0)).alias("max_death_streak"),
        F.coalesce("total_roams", F.lit(0)).alias("total_roams"),
        F.log1p(F.coalesce("avg_cs_sacrifice", F.lit(0.0))).alias("avg_cs_sacrifice"),
        F.coalesce("roam_impact_rate", F.lit(0.5)).alias("roam_impact_rate"))
