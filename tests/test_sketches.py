"""Mergeable quantile sketches: exact while small, within the stated rank error on a hot group."""

from __future__ import annotations

from pyspark.sql import functions as F

from playline.operators import sketches as S


def plain(values, p):
    """The least value whose share of values at or below it reaches p."""
    s = sorted(values)
    return next(v for i, v in enumerate(s, 1) if i / len(s) >= p)


def test_small_ranges_are_exact(spark):
    rows = [(g, v, float((i * 37) % 101)) for g in ("a", None) for v in ("1", "2", "3") for i in range(50 + 10 * int(v))]
    rows += [("a", "1", None), ("b", "1", None), ("a", "2", float("nan"))]
    slices = S.sketch_slices(spark.createDataFrame(rows, "g string, v string, x double"), "x", ["g", "v"])
    for wanted in (("1",), ("2", "3"), ("1", "2", "3")):
        got = {r["g"]: r for r in S.sketched_quartiles(slices.where(F.col("v").isin(*wanted)), ["g"]).collect()}
        assert set(got) == {"a", None}
        for g, r in got.items():
            vals = [x for gg, v, x in rows if gg == g and v in wanted and x is not None and x == x]
            assert (r["q1"], r["median"], r["q3"], r["n"]) == (plain(vals, .25), plain(vals, .5), plain(vals, .75), len(vals))


def test_landings_add_up_and_empty(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("v"), F.col("id").cast("double").alias("x"))
    halves = [S.sketch_slices(df.where(F.col("x") % 2 == i), "x", ["v"]) for i in (0, 1)]
    got = S.sketched_quartiles(S.add_slices(*halves, ["v"])).first()
    assert (got["q1"], got["median"], got["q3"], got["n"]) == (74.0, 149.0, 224.0, 300)
    none = S.sketch_slices(df.where("x < 0"), "x", ["v"])
    assert none.count() == 0 and S.sketched_quartiles(none).count() == 0


def test_rank_error_on_a_hot_group(spark):
    """90 % of 400,000 rows in one group, with a value that a third of them share."""
    df = spark.range(400_000, numPartitions=16).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") % 4).alias("v"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.xxhash64("id") % 1_000_003) / 1_000_003.0).alias("x"))
    k = 1024
    slices = S.sketch_slices(df, "x", ["g", "v"], k)
    assert slices.select(F.max(F.length(S.SKETCH))).first()[0] < 100_000
    quart = S.sketched_quartiles(slices, ["g"], k)
    off = S.measured_rank_error(df, "x", quart, ["g"]).collect()
    assert {r["g"]: r["n"] for r in off} == {"cold": 40_000, "hot": 360_000}
    assert all(0 <= r[c] <= 2 * S.rank_error(k) for r in off for c in ("q1", "median", "q3"))
