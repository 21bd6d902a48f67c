"""Quantiles from mergeable sketches (E9 over ranges of versions).

A KLL sketch per group and slice (a version, a day, a landing) is a few tens of
kilobytes, whatever the slice holds. Slices are kept as rows; any range of them
merges into one sketch without reading the data again, and a new landing only
adds rows. ``explore.exact_quantiles`` stays the exact way.

Values: a sketch gives the least value whose share of values at or below it
reaches the asked share, with a rank error of about ``rank_error(k)`` (with 99 %
confidence). A merged sketch of at most ``k`` values is exact.

Defined cases: NULL values don't count, and a slice without values has no row;
NULL keys are a group of their own; NaN values don't count either (a sketch has
no place for them); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SKETCH_K = 4096
SKETCH = "sketch"


def rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of one quantile at 99 % confidence, as published for KLL sketches."""
    return 2.296 / k ** 0.9021


def sketch_slices(df: DataFrame, col: str, by, k: int = SKETCH_K) -> DataFrame:
    """One sketch of ``col`` per slice (the columns ``by``), combined map-side."""
    v = F.col(col).cast("double")
    return (df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias(SKETCH)))


def merge_slices(slices: DataFrame, by=(), k: int = SKETCH_K) -> DataFrame:
    """The sketches of all slices of each group in one."""
    return slices.groupBy(*by).agg(F.kll_merge_agg_double(SKETCH, F.lit(k)).alias(SKETCH)).where(values_in() > 0)


def add_slices(stored: DataFrame, new: DataFrame, by, k: int = SKETCH_K) -> DataFrame:
    """Stored slices advanced by those of a new landing: equal slices merge, others are added."""
    return merge_slices(stored.unionByName(new), by, k)


def quantile_of(p: float, sketch: str = SKETCH) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))


def values_in(sketch: str = SKETCH) -> Column:
    return F.kll_sketch_get_n_double(sketch)


def sketched_quartiles(slices: DataFrame, by=(), k: int = SKETCH_K) -> DataFrame:
    """q1, median, q3 and n of each group, from the slices handed in (any range of them)."""
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return merge_slices(slices, by, k).select(*by, *[quantile_of(p).alias(n) for n, p in names.items()], values_in().alias("n"))


def measured_rank_error(df: DataFrame, col: str, quartiles: DataFrame, by) -> DataFrame:
    """How far each quartile's true rank is from the asked one, as a share of the
    group's values: 0 if the asked rank lies among the values equal to it. One
    pass over the data beside one row per group; ``by`` joins null-safely."""
    v = F.col(col).cast("double")
    q = quartiles.select(*[F.col(c).alias(f"_g_{c}") for c in by], "q1", "median", "q3")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).join(q, same)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for n in ("q1", "median", "q3"):
        aggs += [F.count_if(F.col("_v") < F.col(n)).alias(f"_lt_{n}"), F.count_if(F.col("_v") <= F.col(n)).alias(f"_le_{n}")]
    counts = rows.groupBy(*by).agg(*aggs)
    off = [F.greatest(F.lit(0.0), F.col(f"_lt_{n}") / F.col("_n") - p, p - F.col(f"_le_{n}") / F.col("_n")).alias(n)
           for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return counts.select(*by, *off, F.col("_n").alias("n"))
