"""Report queries behind the dashboard (R1-R10). Each returns a DataFrame;
presentation order is carried by explicit order columns, never by a global sort
of large data."""

from __future__ import annotations

from functools import reduce

from playline.operators.sequence import number_rows
from pyspark.sql import DataFrame, Window, functions as F

from playline.config import DEFAULT, FEATURE_COLUMNS, AnalysisConfig
from playline.functions.scalars import time_bucket_ord, version_sort_keys
from playline.operators.features import scope

# Incident categories in presentation order (label, flag column).
INCIDENT_CATEGORIES = (
    ("Early Death", "is_early_death"),
    ("Overextension (proxy)", "is_overextension_ahead"),
    ("Deficit Fight (proxy)", "is_deficit_fight"),
    ("Tilt Spiral", "is_tilt_spiral"),
    ("Post-Laning Throw (proxy)", "is_post_laning_throw"),
)


def _win_rate():
    return F.avg(F.col("win").cast("int")).cast("double")


# R1
def kpi_overview(sessions: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return scope(sessions, cfg).agg(
        F.count(F.lit(1)).cast("int").alias("total_games"), _win_rate().alias("win_rate"),
        F.avg("kda").alias("avg_kda"), F.avg("cs_per_min").alias("avg_cs_per_min"))


# R2
def version_stats(sessions: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Win rate per version with natural (numeric major, minor) order keys."""
    g = scope(sessions, cfg).groupBy("game_version").agg(
        F.count(F.lit(1)).cast("int").alias("games"), _win_rate().alias("win_rate"))
    major, minor = version_sort_keys("game_version")
    return g.select("game_version", "games", "win_rate", major.alias("version_major"),
                    minor.alias("version_minor"))


# R3
def time_bucket_stats(fm: DataFrame) -> DataFrame:
    return (fm.groupBy("time_bucket").agg(F.count(F.lit(1)).cast("int").alias("games"),
                                          _win_rate().alias("win_rate"))
            .withColumn("bucket_order", time_bucket_ord("time_bucket")))


# R4 (+ R11)
def swing_summary(fm: DataFrame) -> DataFrame:
    throws = F.coalesce(F.sum(F.col("is_throw").cast("int")), F.lit(0)).cast("int")
    comebacks = F.coalesce(F.sum(F.col("is_comeback").cast("int")), F.lit(0)).cast("int")
    total = F.count(F.lit(1)).cast("int")
    return (fm.agg(throws.alias("throws"), comebacks.alias("comebacks"), total.alias("total"))
            .withColumn("throw_rate", F.when(F.col("total") == 0, F.lit(0.0))
                        .otherwise(F.col("throws") / F.col("total"))))


# R5 / P8 / E17
def matchup_table(matchups: DataFrame, champion: str | None = None) -> DataFrame:
    """Dashboard matchup table: optional champion filter (None = all),
    win rate in percent, everything rounded to 2 decimals, sign of the cs diff."""
    m = matchups if champion in (None, "All Champions") else matchups.where(F.col("champion_name") == champion)
    return m.select("champion_name", "opp_champion_name", "games",
                    F.round(F.col("our_winrate") * 100, 2).alias("our_winrate_pct"),
                    F.round("cs_diff", 2).alias("cs_diff"),
                    F.round("our_avg_kda", 2).alias("our_avg_kda"),
                    F.round("opp_avg_kda", 2).alias("opp_avg_kda"),
                    (F.col("cs_diff") >= 0).alias("cs_ahead"))


def signed_order(matchups: DataFrame) -> DataFrame:
    """Pairs in order of the signed difference (1 = most behind); one row per pair, numbered over all tasks."""
    return number_rows(matchups, [], ["cs_diff", "champion_name", "opp_champion_name"], out="diff_order").withColumn(
        "diff_order", F.col("diff_order").cast("int"))


# R6
def cluster_summary(fm: DataFrame, labels: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    return (labels.join(fm, "match_id").groupBy("cluster_id")
            .agg(F.count(F.lit(1)).cast("int").alias("size"), *[F.avg(c).alias(c) for c in features]))


def centroid_z(summary: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    """Z-score each feature column across the cluster rows (population std; 0 -> 1).

    ``summary`` has one row per cluster (k rows), so the column statistics are
    a window over those k rows (bounded by k, not by the data)."""
    every = Window.partitionBy()
    out = [F.col("cluster_id")]
    for c in features:
        sd = F.stddev_pop(c).over(every)
        out.append(((F.col(c) - F.avg(c).over(every)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c))
    return summary.select(*out)


# R7
def pace_curves(ticks: DataFrame, labels: DataFrame, min_count: int = 3, min_share: float = 0.5) -> DataFrame:
    """Mean gold per (cluster, tick), kept when the tick has at least
    greatest(min_count, round(cluster size * min_share)) sessions."""
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    per = (labels.join(ticks, "match_id").groupBy("cluster_id", "timestamp_min")
           .agg(F.count(F.lit(1)).alias("match_count"), F.avg(F.col("gold").cast("double")).alias("avg_gold")))
    need = F.greatest(F.lit(min_count).cast("double"), F.round(F.col("cluster_size") * F.lit(min_share)))
    return (per.join(sizes, "cluster_id")
            .where(F.col("match_count") >= need)
            .select("cluster_id", "timestamp_min", "avg_gold"))


def missing_members(curves: DataFrame, members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Expected members (e.g. cluster ids) with no retained row."""
    return members.select(key).distinct().join(curves.select(key), key, "left_anti")


def named(df: DataFrame, names: dict[int, str], key: str = "cluster_id", out: str = "cluster_name") -> DataFrame:
    """Display names by cluster id; ids without a name get NULL.

    Names belong to one fitted model, so they are an input, never a constant here."""
    table = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]) if names else None
    return df.withColumn(out, table[F.col(key)] if names else F.lit(None).cast("string"))


def profile_names(summary: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    """A name for each cluster from its own profile: the feature that lies farthest
    from the other clusters (z-score over the k rows) and its direction."""
    z = centroid_z(summary, features)
    far = F.array_max(F.array(*[F.struct(F.abs(F.col(c)).alias("d"), F.lit(c).alias("f"), F.col(c).alias("z")) for c in features]))
    return z.select("cluster_id", F.concat(F.when(far["z"] >= 0, F.lit("high ")).otherwise(F.lit("low ")),
                                           far["f"]).alias("cluster_name"))


# R8 / O4
def dimension_members(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()


# R9
def incident_breakdown(ctx: DataFrame, with_total: bool = False) -> DataFrame:
    """Five overlapping category counts (one aggregate pass), one row per
    category with its presentation order."""
    aggs = [F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("long").alias(f"n{i}")
            for i, (_, c) in enumerate(INCIDENT_CATEGORIES)]
    aggs.append(F.count(F.lit(1)).alias("total"))
    rows = F.array(*[F.struct(F.lit(lab).alias("category"), F.col(f"n{i}").alias("deaths"),
                              F.lit(i).alias("category_order"), F.col("total").alias("total"))
                     for i, (lab, _) in enumerate(INCIDENT_CATEGORIES)])
    out = ctx.agg(*aggs).select(F.inline(rows))
    return out if with_total else out.drop("total")


# R10 / A14
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one aggregate per table, unioned by name."""
    parts = [df.agg(F.count(F.lit(1)).cast("long").alias("row_count")).select(F.lit(name).alias("table_name"),
                                                                            "row_count")
             for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
