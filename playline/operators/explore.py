"""Exploration tables (the data behind the analysis notebook's plots, E1-E24).

Generic pieces: ``edge_histogram`` / ``equal_width_histogram`` (bin index as
an expression, then one grouped count - partial aggregation makes a hot bin
cheap), ``quartiles``, ``profile`` and ``pairwise_corr`` (single-pass
aggregates). Drawing is out of scope; these return the tables.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from playline.config import DEFAULT, AnalysisConfig
from playline.functions.scalars import cut, first_label, local_hour

# Label sets used by the exploration tables.
LOCAL_TIME_BUCKETS = (("morning (6-11)", 6, 11), ("afternoon (12-17)", 12, 17), ("evening (18-22)", 18, 22))
LOCAL_NIGHT = "night (23-5)"
LOCAL_OFFSET_HOURS = 7
FORM_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.01)
FORM_LABELS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")
HEX_WIDTH = 375.0     # a 40th of the map
GRID_CELL = 375          # square cells over a 15000-unit map, 40 per side
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _by(by):
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


# ---------------------------------------------------------------- generic --
def edge_histogram(df: DataFrame, col: str, edges, by=None) -> DataFrame:
    """Counts per bin [e_i, e_{i+1}), last bin closed, values outside dropped.

    Non-empty bins only: bin (0-based), bin_lo, bin_hi, count."""
    x = F.col(col)
    idx = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        last = i == len(edges) - 2
        cond = (x >= lo) & ((x <= hi) if last else (x < hi))
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    lo_e = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("bin") + 1)
    hi_e = F.element_at(F.array(*[F.lit(float(e)) for e in edges[1:]]), F.col("bin") + 1)
    return (df.select(*_by(by), idx.alias("bin")).where(F.col("bin").isNotNull())
            .groupBy(*_by(by), "bin").agg(F.count(F.lit(1)).alias("count"))
            .select(*_by(by), "bin", lo_e.alias("bin_lo"), hi_e.alias("bin_hi"), "count"))


def equal_width_histogram(df: DataFrame, col: str, nbins: int, by=None) -> DataFrame:
    """``nbins`` equal-width bins over the data's [min, max] (max goes to the
    last bin; a constant column gets the range [v - 0.5, v + 0.5])."""
    stats = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx"))
    rng = stats.select(F.struct(
        F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5).alias("lo"),
        F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5).alias("hi"))).scalar()
    mn, mx = rng["lo"], rng["hi"]     # one scalar subquery, reused
    width = (mx - mn) / F.lit(nbins)
    idx = F.least(F.floor((F.col(col) - mn) / width), F.lit(nbins - 1)).cast("int")
    return (df.where(F.col(col).isNotNull()).select(*_by(by), idx.alias("bin"))
            .groupBy(*_by(by), "bin").agg(F.count(F.lit(1)).alias("count"))
            .select(*_by(by), "bin", (mn + F.col("bin") * width).alias("bin_lo"),
                    (mn + (F.col("bin") + 1) * width).alias("bin_hi"), "count"))


def exact_quantiles(df: DataFrame, col: str, probs, by=None, accuracy: int = 10_000) -> DataFrame:
    """Exact linearly interpolated quantiles per group, without sorting or buffering a group.

    ``percentile_approx`` brackets every wanted rank (its rank error is at most
    n / accuracy; groups of up to ``accuracy`` rows take their whole range). One
    more pass counts the values below each bracket and the occurrences of each
    value inside it, combined map-side, so ties cost one row; the running count
    over those few values gives the value at each rank. Same result as
    ``quantile_cont`` / numpy's default interpolation."""
    g = _by(by)
    vals = df.where(F.col(col).isNotNull()).select(*(g or [F.lit(0).alias("_all")]), F.col(col).cast("double").alias("_v"))
    g = g or ["_all"]
    edge = 3.0 / accuracy
    around = [min(1.0, max(0.0, q + d)) for q in probs for d in (-edge, edge)]
    b = vals.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                             F.percentile_approx("_v", around, accuracy).alias("_p"))
    small = F.col("_n") <= accuracy
    b = b.select(*[F.col(c).alias(f"_g_{c}") for c in g], "_n", F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.when(small, F.col("_min")).otherwise(F.col("_p")[2 * i]).alias("lo"),
        F.when(small, F.col("_max")).otherwise(F.col("_p")[2 * i + 1]).alias("hi")) for i, q in enumerate(probs)]).alias("_b"))
    same = None
    for c in g:
        e = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        same = e if same is None else same & e
    # a value below a bracket counts as one NULL entry of it
    near = F.filter("_b", lambda x: F.col("_v") <= x["hi"])
    hit = vals.join(b, same).select(*g, "_n", "_v", F.explode(near).alias("_x"))
    inside = F.when(F.col("_v") >= F.col("_x.lo"), F.col("_v"))
    counts = (hit.groupBy(*g, F.col("_x.q").alias("q"), inside.alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")))
    upto = Window.partitionBy(*g, "q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("q") * (F.col("_n") - 1)
    ranked = counts.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_pos", pos)
    at = lambda r: F.min(F.when(F.col("_cum") >= r, F.col("_v")))
    out = ranked.groupBy(*g, "q").agg(at(F.floor("_pos") + 1).alias("_lo"), at(F.ceil("_pos") + 1).alias("_hi"),
                                      F.max(F.col("_pos") - F.floor("_pos")).alias("_frac"))
    return out.select(*_by(by), "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("value"))


def quartiles(df: DataFrame, col: str, by=None, exact: bool = True) -> DataFrame:
    """Box-plot statistics per group: q1, median, q3 (exact and distributed by
    default, ``percentile_approx`` sketches when ``exact`` is off), min, max, n."""
    g = _by(by)
    stats = df.groupBy(*g).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))
    if exact:
        q = exact_quantiles(df, col, (0.25, 0.5, 0.75), by)
        wide = q.groupBy(*g).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(name)
                                   for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    else:
        p = F.percentile_approx(col, [0.25, 0.5, 0.75], 10000)
        wide = df.groupBy(*g).agg(p.alias("_q")).select(*g, F.col("_q")[0].alias("q1"),
                                                        F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    if not g:   # one row on each side: join them on a constant key
        stats, wide, g = stats.withColumn("_all", F.lit(0)), wide.withColumn("_all", F.lit(0)), ["_all"]
        return stats.join(wide, g, "left").select("q1", "median", "q3", "min", "max", "n")
    return stats.join(wide, g, "left").select(*g, "q1", "median", "q3", "min", "max", "n")


def profile(df: DataFrame, cols=None) -> DataFrame:
    """Per column: non-null count, NULL count; mean, min and max of numbers and
    booleans (as 0/1); least and greatest value of the others as text.

    One aggregate pass over ``df`` produces a single wide row; ``inline`` of
    an array of per-column structs turns it into one row per column."""
    number = (T.NumericType, T.BooleanType)
    aggs = []
    for c in cols or df.columns:
        x, numeric = F.col(f"`{c}`"), isinstance(df.schema[c].dataType, number)
        v = x.cast("double") if numeric else F.lit(None).cast("double")
        aggs += [F.count(x).alias(f"{c}|n"), F.count_if(x.isNull()).alias(f"{c}|nulls"),
                 F.avg(v).alias(f"{c}|mean"), F.min(v).alias(f"{c}|min"), F.max(v).alias(f"{c}|max"),
                 (F.min(x).cast("string") if not numeric else F.lit(None).cast("string")).alias(f"{c}|low"),
                 (F.max(x).cast("string") if not numeric else F.lit(None).cast("string")).alias(f"{c}|high")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}|{k}`").alias(a) for k, a in (
        ("n", "n"), ("nulls", "nulls"), ("mean", "mean"), ("min", "min"), ("max", "max"), ("low", "low"),
        ("high", "high"))]) for c in cols or df.columns])
    return df.agg(*aggs).select(F.inline(rows))


def pairwise_corr(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation for every pair (strict lower triangle) in one
    aggregate pass, each over the rows where both values are present; a
    constant column yields NULL instead of an error."""
    aggs, rows = [], []
    for i, (a, b) in enumerate(combinations(cols, 2)):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa, xb = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        aggs += [F.covar_pop(xa, xb).alias(f"c{i}"), F.stddev_pop(xa).alias(f"a{i}"),
                 F.stddev_pop(xb).alias(f"b{i}")]
        c, sa, sb = F.col(f"c{i}"), F.col(f"a{i}"), F.col(f"b{i}")
        rows.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"),
                             F.when((sa > 0) & (sb > 0), c / (sa * sb)).alias("corr")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- E1/A13 ---
def profile_counts(sessions: DataFrame, ticks: DataFrame, incidents: DataFrame) -> DataFrame:
    """Coverage counts over three tables in one row: one aggregate per table."""
    s = sessions.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("opp_champion_name").alias("opp"))).scalar()
    t = ticks.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("position_x").alias("pos"))).scalar()
    d = incidents.agg(F.count(F.lit(1))).scalar()
    return sessions.sparkSession.range(1).select(
        s["n"].alias("total_matches"), d.alias("total_deaths"), t["n"].alias("total_timeline_rows"),
        t["pos"].alias("rows_with_position"), s["opp"].alias("matches_with_opp_mid"))


# A12
def distinct_counts(ctx: DataFrame, ex: DataFrame) -> DataFrame:
    one = ctx.sparkSession.range(1)
    return one.select(ctx.agg(F.count_distinct("match_id")).scalar().alias("sessions_with_incidents"),
                      ex.agg(F.count_distinct("match_id")).scalar().alias("sessions_with_excursions"))


# E2, E3
def hist_incident_tick(ctx: DataFrame) -> DataFrame:
    return edge_histogram(ctx, "timestamp_min", list(range(0, 45)))


def hist_lead(ctx: DataFrame, nbins: int = 40) -> DataFrame:
    return equal_width_histogram(ctx, "gold_lead_approx", nbins)


# E4
def incident_breakdown_pct(ctx: DataFrame) -> DataFrame:
    from playline.operators.reports import incident_breakdown
    b = incident_breakdown(ctx, with_total=True)
    return b.select("category", F.col("deaths").alias("death_count"),
                    F.when(F.col("total") == 0, F.lit(0.0))
                    .otherwise(F.round(F.col("deaths") / F.col("total") * 100, 1)).alias("pct_of_deaths"),
                    "category_order")


# E5
def incident_category(ctx: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    lab = first_label([(F.col("is_overextension_ahead"), "overextension_ahead"),
                       (F.col("is_deficit_fight"), "deficit_fight"),
                       (F.col("is_early_death"), "early_death")], "neutral")
    return (ctx.where(F.col("timestamp_min") <= cfg.laning_end)
            .select("match_id", "death_number", "timestamp_min", "gold_lead_approx", lab.alias("category")))


# E6
def spiral_sessions(ctx: DataFrame) -> DataFrame:
    return (ctx.groupBy("match_id").agg(F.count(F.lit(1)).alias("deaths"),
                                        F.sum(F.col("is_tilt_spiral").cast("int")).cast("long").alias("tilt_spirals"))
            .withColumn("had_tilt_spiral", F.col("tilt_spirals") > 0))


def spiral_histogram(ctx: DataFrame, edges: int = 20) -> DataFrame:
    """Sessions per number of incidents, stacked by whether they hold a spiral:
    unit bins from 0, the last one closed (``edges`` edges); more incidents fall outside."""
    top = edges - 2
    return (spiral_sessions(ctx).where(F.col("deaths") <= edges - 1)
            .groupBy(F.least("deaths", F.lit(top)).cast("int").alias("bin"), "had_tilt_spiral")
            .agg(F.count(F.lit(1)).alias("games")))


# E8, E9
def hist_delta_by_win(swing: DataFrame, nbins: int = 30) -> DataFrame:
    return equal_width_histogram(swing, "gold_delta", nbins, by="win")


def delta_quartiles(swing: DataFrame) -> DataFrame:
    return quartiles(swing, "gold_delta", by="win")


def cost_quartiles(ex: DataFrame) -> DataFrame:
    return quartiles(ex, "cs_sacrifice", by="roam_result")


# E10, E11
def game_type(swing: DataFrame) -> DataFrame:
    return swing.select("match_id", first_label([(F.col("is_throw"), "throw"), (F.col("is_comeback"), "comeback")],
                                                "neutral").alias("game_type"))


def _share_of_groups(grouped: DataFrame, count_col: str = "count"):
    """Total over the grouped rows (one row per category: bounded by the domain)."""
    return F.sum(count_col).over(Window.partitionBy())


def game_type_share(swing: DataFrame) -> DataFrame:
    g = game_type(swing).groupBy("game_type").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("pct", F.round(F.col("count") / _share_of_groups(g) * 100, 1))


def game_type_curve(swing: DataFrame, ticks: DataFrame, max_tick: int = 30) -> DataFrame:
    return (ticks.where(F.col("timestamp_min") <= max_tick).join(game_type(swing), "match_id")
            .groupBy("game_type", "timestamp_min").agg(F.avg(F.col("gold").cast("double")).alias("avg_gold")))


# E12
def position_grid(ticks: DataFrame, cfg: AnalysisConfig = DEFAULT, cell: int = GRID_CELL) -> DataFrame:
    t = ticks.where(F.col("timestamp_min").between(cfg.phase_start, cfg.phase_end) & F.col("position_x").isNotNull())
    return (t.select(F.floor(F.col("position_x") / cell).cast("int").alias("cell_x"),
                     F.floor(F.col("position_y") / cell).cast("int").alias("cell_y"))
            .groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n")))


def hexagon(x, y, width: float):
    """(q, r) of the hexagon that holds a point, and its centre: pointy-top
    hexagons ``width`` wide, r counts rows upwards, q along a row. Rows of even
    and of odd r are two rectangular lattices; the nearer centre wins, the even one at a tie."""
    high = width * 3 ** 0.5
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    i, j = F.floor(x / width + 0.5), F.floor(y / high + 0.5)        # nearest centre (i, j) of even rows
    k, m = F.floor(x / width), F.floor(y / high)                    # nearest centre (k + 1/2, m + 1/2) of odd rows
    even, odd = (i * width, j * high), ((k + 0.5) * width, (m + 0.5) * high)
    dist = lambda c: (x - c[0]) * (x - c[0]) + (y - c[1]) * (y - c[1])
    second = dist(odd) < dist(even)
    q, r = F.when(second, k - m).otherwise(i - j), F.when(second, 2 * m + 1).otherwise(2 * j)
    return (q.cast("int"), r.cast("int"), F.when(second, odd[0]).otherwise(even[0]), F.when(second, odd[1]).otherwise(even[1]))


def position_hex(ticks: DataFrame, cfg: AnalysisConfig = DEFAULT, width: float = HEX_WIDTH) -> DataFrame:
    """Density of the phase positions in hexagons; rows without a position don't count."""
    t = ticks.where(F.col("timestamp_min").between(cfg.phase_start, cfg.phase_end)
                    & F.col("position_x").isNotNull() & F.col("position_y").isNotNull())
    q, r, cx, cy = hexagon("position_x", "position_y", width)
    return (t.groupBy(q.alias("hex_q"), r.alias("hex_r"))
            .agg(F.count(F.lit(1)).alias("n"), F.first(cx).alias("center_x"), F.first(cy).alias("center_y")))


# E13, E14, E15
def excursion_duration(ex: DataFrame) -> DataFrame:
    d = ex.select((F.col("roam_end_min") - F.col("roam_start_min") + 1).alias("duration"))
    return edge_histogram(d, "duration", list(range(1, 10)))


def excursion_impact(ex: DataFrame) -> DataFrame:
    g = ex.groupBy("roam_result").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("share", F.col("count") / _share_of_groups(g))


def excursion_start(ex: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return edge_histogram(ex, "roam_start_min", list(range(cfg.phase_start, cfg.phase_end + 2)), by="roam_result")


# E16
def top_matchups(matchups: DataFrame, k: int = 10) -> DataFrame:
    """Top-k pairs by games (the limit is the feature); ties by names."""
    return matchups.orderBy(F.desc("games"), "champion_name", "opp_champion_name").limit(k)


# E19
def form_bucket_rate(form: DataFrame) -> DataFrame:
    b = cut("tilt_index", FORM_EDGES, FORM_LABELS)
    return (form.select(b.alias("tilt_bucket"), "win").where(F.col("tilt_bucket").isNotNull())
            .groupBy("tilt_bucket").agg(F.avg(F.col("win").cast("double")).alias("win_rate"),
                                        F.count(F.lit(1)).alias("games")))


# E20
def local_time_rate(sessions: DataFrame, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    h = local_hour("game_datetime", offset_hours)
    lab = first_label([(h.between(lo, hi), name) for name, lo, hi in LOCAL_TIME_BUCKETS], LOCAL_NIGHT)
    return (sessions.select(lab.alias("time_bucket"), "win").groupBy("time_bucket")
            .agg(F.avg(F.col("win").cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("games")))


# E21 / J16
def weekday_rate(sessions: DataFrame) -> DataFrame:
    """Win rate per UTC weekday (Mon=0) over a dense 7-day domain (NULL when no games)."""
    per = (sessions.groupBy(F.weekday("game_datetime").alias("day_of_week"))
           .agg(F.avg(F.col("win").cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("games")))
    names = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.col("day_of_week") + 1)
    days = sessions.sparkSession.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    return (days.join(per, "day_of_week", "left")
            .select("day_of_week", names.alias("day_name"), "win_rate",
                    F.coalesce("games", F.lit(0)).alias("games")))


# E23, E24
def cluster_outcomes(fm: DataFrame, labels: DataFrame) -> DataFrame:
    return (labels.join(fm, "match_id").groupBy("cluster_id")
            .agg(F.count(F.lit(1)).alias("games"), F.avg(F.col("win").cast("double")).alias("win_rate"),
                 F.avg("gold_delta").alias("avg_gold_delta"), F.avg("total_deaths").alias("avg_deaths")))


def pace_curves_raw(ticks: DataFrame, labels: DataFrame) -> DataFrame:
    return (labels.join(ticks, "match_id").groupBy("cluster_id", "timestamp_min")
            .agg(F.avg(F.col("gold").cast("double")).alias("avg_gold")))
