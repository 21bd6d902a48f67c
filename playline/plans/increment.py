"""Feature matrix kept up to date from what new commits added.

New sessions move every global mean, so every row of the matrix changes; what
must not be read again is the ticks and incidents. Four tables of the store
hold what the means can't move, and how far they have come:

* ``feature_state``     one compact row per scoped session: anchor gold, spiral
  aggregates, early incidents as (tick, gold, count), and its excursions, final
  where the session has positions; else the few ticks of the load window, to be
  held against the new baseline;
* ``feature_form``      one row per scoped session with its entity, number and form;
* ``feature_baseline``  per tick, exact sums that merge by addition;
* ``feature_progress``  the store version that the other three have taken in.

A step reads the commits after that version. Sessions with rows there are
worked out anew from the buckets they fall into; of a baseline only rows that
were not counted yet are added; a form continues from the last N rows before
the entity's first new session, so late sessions renumber only what follows
them. State rows are appended, the latest of a session counts. The matrix is
then one pass over the state. A table replaced since, or other parameters,
start the state anew. A step that was cut off is repeated under the same name.

Defined results: empty or absent tables give an empty matrix; ticks or
incidents without a session count once their session is there; repeated steps
without news change nothing; equal start times are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playline.config import DEFAULT, AnalysisConfig
from playline.operators import features as FT
from playline.operators.features import KEY, TICK
from playline.operators.sequence import gap_flags, nearest_anchor, rolling_prior_mean
from playline.plans.tables import TableStore, ensure_tables
from playline.session import cut_lineage

SOURCES = ("sessions", "ticks", "incidents")
STATE, FORM, BASELINE, PROGRESS = "feature_state", "feature_form", "feature_baseline", "feature_progress"
TABLES = (STATE, FORM, BASELINE, PROGRESS)
MATRIX = "feature_matrix"
EXACT = "decimal(38,0)"


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key the row of the last step that wrote it."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), "step").alias("_r")).select(*key, "_r.*")


# ------------------------------------------------------------ one step -----
def tick_sums(ticks: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Mergeable baseline: exact sums per tick (gold over all ticks, cs over the phase ticks)."""
    cs = F.when(F.col(TICK).between(cfg.phase_start, cfg.phase_end), F.col("cs")).cast("long")
    return ticks.groupBy(TICK).agg(
        F.count("gold").alias("gold_n"), F.sum(F.col("gold").cast(EXACT)).cast(EXACT).alias("gold_sum"),
        F.count(cs).alias("cs_n"), F.sum(cs.cast(EXACT)).cast(EXACT).alias("cs_sum"),
        F.sum((cs * cs).cast(EXACT)).cast(EXACT).alias("cs_squares"))


def session_state(scoped: DataFrame, ticks: DataFrame, incidents: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per scoped session: all that its features need but the means of the scope."""
    loaded = ticks.where(F.col(TICK).between(cfg.load_start, cfg.load_end))
    placed = F.max(F.col(TICK).between(cfg.phase_start, cfg.phase_end) & F.col("position_x").isNotNull())
    mode = loaded.groupBy(KEY).agg(placed.alias("_placed"), F.array_sort(F.collect_list(F.struct(
        TICK, "cs", "kills", "position_x", "position_y"))).alias("_trace"))     # at most the ticks of the load window
    by_place = mode.where("_placed").select(KEY, F.inline("_trace"))
    no_base = by_place.sparkSession.createDataFrame([], f"{TICK} int, avg_cs double, std_cs double")
    runs = FT.excursion_runs(by_place, no_base, cfg)
    runs = runs.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(
        *[c for c in runs.columns if c != KEY]))).alias("runs"))
    flagged = gap_flags(incidents, KEY, "death_number", TICK, cfg.spiral_gap, out="is_tilt_spiral", seq="death_number")
    spirals = FT.incident_agg(flagged.withColumn("is_overextension_ahead", F.lit(False))).drop("deaths_while_ahead")
    early = (incidents.where(F.col(TICK) <= cfg.laning_end)
             .groupBy(KEY, TICK, F.coalesce("gold_at_death", F.lit(0)).cast("long").alias("gold")).agg(F.count(F.lit(1)).alias("n"))
             .groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(TICK, "gold", "n"))).alias("early")))
    anchor = nearest_anchor(ticks, KEY, TICK, "gold", cfg.anchor_tick, cfg.anchor_low, cfg.anchor_high, out="anchor_gold")
    return (scoped.select(KEY, "win", "game_datetime", "champion_name", "cs_per_min")
            .join(anchor.select(KEY, "anchor_gold"), KEY, "left").join(spirals, KEY, "left").join(early, KEY, "left")
            .join(runs, KEY, "left")
            .join(mode.select(KEY, F.when(~F.col("_placed"), F.col("_trace")).alias("trace")), KEY, "left"))


def continued_form(new: DataFrame, old: DataFrame | None, cfg: AnalysisConfig) -> DataFrame:
    """Form of new sessions and of those behind them in their entity's order.

    ``old``: numbered form rows of at least these entities. Of them the N rows
    before an entity's first new session, and all rows after it, are read on."""
    cols, order = [KEY, "entity", "game_datetime", "win"], F.struct("game_datetime", KEY)
    rows = new.select(*cols)
    n = cfg.rolling_window
    form = lambda d: rolling_prior_mean(d, ["entity"], ["game_datetime", KEY], "win", n=n, neutral=cfg.neutral_form,
                                        out="tilt_index", seq_out="game_number")
    if old is None:
        return form(rows).select(*cols, "tilt_index", "game_number")
    first = rows.groupBy("entity").agg(F.min(order).alias("_first"))
    met = old.select(*cols, "game_number").join(first, "entity")
    # rows of the entity before its first new one: their numbers are 1..m
    before = met.groupBy("entity").agg(F.max(F.when(order < F.col("_first"), F.col("game_number"))).alias("_m"))
    kept = (met.drop("_first").join(before.withColumn("_m", F.coalesce("_m", F.lit(0))), "entity")
            .where(F.col("game_number") > F.col("_m") - n).select(*cols))
    start = before.select("entity", F.greatest(F.coalesce("_m", F.lit(0)) - n, F.lit(0)).alias("_skipped"),
                          F.coalesce("_m", F.lit(0)).alias("_m"))
    out = form(kept.unionByName(rows)).join(start, "entity", "left")
    return (out.withColumn("game_number", F.col("game_number") + F.coalesce("_skipped", F.lit(0)))
            .where(F.col("game_number") > F.coalesce("_m", F.lit(0)))
            .select(*cols, "tilt_index", "game_number"))


def changed_sessions(store: TableStore, after: int) -> DataFrame:
    """Keys with rows in a commit after that version."""
    keys = [f.select(KEY) for f in (store.read(t, after=after) for t in SOURCES) if f is not None]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()


def _buckets(store: TableStore, df: DataFrame, key: str) -> list[int]:
    """The buckets of these keys: at most ``store.buckets`` numbers."""
    return [r[0] for r in df.select(store.bucket(key)).distinct().collect()]


def _progress(store: TableStore, cfg: AnalysisConfig) -> int:
    """The version the state has taken in; 0 if it must start anew."""
    done = store.read(PROGRESS)
    row = done.orderBy(F.desc("upto")).first() if done is not None else None
    if row is None or row["config"] != repr(cfg) or any(store.replaced_after(t, row["upto"]) for t in SOURCES):
        return 0
    return row["upto"]


def _source_version(store: TableStore) -> int:
    return max(store.last_commit(t)["version"] for t in SOURCES)


def advance_state(store: TableStore, cfg: AnalysisConfig = DEFAULT) -> int:
    """Take the commits since the last step into the state; returns the version it stands at."""
    ensure_tables(store)
    done, now = _progress(store, cfg), _source_version(store)
    if done == now:
        return now
    frames = step_frames(store, done, cfg)
    frames[PROGRESS] = store.spark.createDataFrame([(now, repr(cfg))], "upto long, config string")
    frames = {t: f if t in (PROGRESS, BASELINE) else f.withColumn("step", F.lit(now).cast("long")) for t, f in frames.items()}
    # a step that starts anew after another must not take its name
    name = f"features-{now}" if done else f"features-{now}-anew-{store.version()}"
    store.commit(frames, replace=() if done else TABLES, name=name)
    return now


def step_frames(store: TableStore, done: int, cfg: AnalysisConfig = DEFAULT) -> dict[str, DataFrame]:
    """State, form and baseline rows that the commits after version ``done`` add."""
    at, scoped = None, FT.scope(store.read("sessions"), cfg)     # a first step reads all
    if done:
        changed = changed_sessions(store, done)
        at = _buckets(store, changed, KEY)
        # written once: every part of the step starts from the changed sessions
        scoped = cut_lineage(FT.scope(store.read("sessions", at), cfg).join(changed, KEY, "left_semi"))
    ticks, incidents = (FT.in_scope(store.read(t, at), scoped) for t in ("ticks", "incidents"))
    out = {STATE: session_state(scoped, ticks, incidents, cfg)}
    fresh = store.read("sessions", at, after=done)
    fresh = FT.scope(fresh, cfg) if fresh is not None else scoped.limit(0)     # sessions are written once
    added = store.read("ticks", at, after=done)
    old = store.read("ticks", at, upto=done) if done else None
    # every tick of a new session counts, of a known one only its new ticks
    uncounted = [FT.in_scope(added, scoped)] if added is not None else []
    if old is not None:
        uncounted.append(FT.in_scope(old, fresh))
    sums = [tick_sums(u, cfg) for u in uncounted] or [tick_sums(ticks.limit(0), cfg)]
    out[BASELINE] = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    new = fresh.withColumnRenamed("puuid", "entity")
    stored = store.read(FORM, _buckets(store, new, "entity")) if done else None
    out[FORM] = continued_form(new, latest(stored, "entity", KEY) if stored is not None else None, cfg)
    return out


# ---------------------------------------------------------- the matrix -----
def merged_baseline(rows: DataFrame) -> DataFrame:
    """Means and sample deviation per tick from the added sums, in exact arithmetic up to the last division."""
    s = rows.groupBy(TICK).agg(*[F.sum(c).alias(c) for c in ("gold_n", "gold_sum", "cs_n", "cs_sum", "cs_squares")])
    n = F.col("cs_n").cast("double")
    spread = (F.col("cs_n").cast("decimal(18,0)") * F.col("cs_squares").cast("decimal(19,0)")
              - F.col("cs_sum").cast("decimal(18,0)") * F.col("cs_sum").cast("decimal(18,0)")).cast("double")
    return s.select(TICK, F.when(F.col("gold_n") > 0, F.col("gold_sum").cast("double") / F.col("gold_n")).alias("avg_gold"),
                    F.when(n > 0, F.col("cs_sum").cast("double") / n).alias("avg_cs"),
                    F.when(n > 1, F.sqrt(spread / (n * (n - 1)))).alias("std_cs"))


def matrix_from_state(state: DataFrame, form: DataFrame, baseline: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The feature matrix from the latest state rows: no tick or incident is read."""
    st, base = latest(state, KEY), merged_baseline(baseline)
    mean, rate = FT.mean_anchor(st), FT.mean_rate(st)
    # the early ticks' mean gold as one small map: at most ``laning_end`` + 1 entries
    gold = (base.where(F.col(TICK) <= cfg.laning_end).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(TICK), F.coalesce("avg_gold", F.lit(0.0)))))).scalar())
    st = st.withColumn("_gold", gold)
    ahead = F.aggregate("early", F.lit(0).cast("long"), lambda a, x: a + F.when(
        x["gold"] - F.coalesce(F.try_element_at("_gold", x[TICK]), F.lit(0.0)) > cfg.swing_threshold, x["n"]).otherwise(F.lit(0)))
    runs = st.select(KEY, F.inline("runs")).unionByName(
        FT.excursion_runs(st.select(KEY, F.inline("trace")), base.select(TICK, "avg_cs", "std_cs"), cfg))
    exc = FT.excursion_agg(FT.excursion_costs(runs, rate))
    form = latest(form, "entity", KEY).select(KEY, "tilt_index")
    fm = (st.withColumn("deaths_while_ahead", F.when(F.col("total_deaths").isNotNull(), F.coalesce(ahead, F.lit(0)).cast("int")))
          .withColumns({c: x for c, x in zip(("gold_delta", "is_throw", "is_comeback"), FT.swing_columns(mean, cfg))})
          .select("*", *FT.temporal_columns("game_datetime")).join(form, KEY).join(exc, KEY, "left"))
    return FT.matrix_columns(fm)


def refresh_features(store: TableStore, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Advance the state, then replace ``feature_matrix`` (K3) from it."""
    advance_state(store, cfg)
    written, state = store.last_commit(MATRIX), store.last_commit(PROGRESS)
    if written and written["version"] > state["version"] and written["commit"].startswith("c-matrix-"):
        return store.read(MATRIX)
    fm = matrix_from_state(*(store.read(t) for t in (STATE, FORM, BASELINE)), cfg)
    store.commit({MATRIX: fm}, replace=(MATRIX,), name=f"matrix-{store.version()}")
    return store.read(MATRIX)
