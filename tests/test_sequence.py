"""Sequence primitives, including skew: one group holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from playline.operators.sequence import bool_islands, gap_flags, max_true_run, nearest_anchor, number_rows, rolling_prior_mean


def skewed(spark, n=3000):
    # group 'hot' holds ~90% of the rows; ties on ts broken by id
    return spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).otherwise(F.lit("hot"))
        .alias("grp"), (F.col("id") * 7919 % 1000).alias("ts"), F.col("id"),
        ((F.col("id") * 31) % 3 == 0).alias("flag"))


def test_number_rows_matches_row_number_under_skew(spark):
    df = skewed(spark)
    got = number_rows(df, ["grp"], ["ts", "id"], out="n", num_partitions=16)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("ts", "id")).cast("long"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # the hot group really was split over several range partitions
    parts = (df.repartitionByRange(16, "grp", "ts", "id").where("grp = 'hot'")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_global_numbering(spark):
    df = skewed(spark, 500)
    got = number_rows(df, [], ["ts", "id"], out="n", num_partitions=7)
    assert sorted(r.n for r in got.collect()) == list(range(1, 501))
    first = got.orderBy("n").first()
    assert (first.ts, first.id) == min((r.ts, r.id) for r in df.collect())


def test_rolling_prior_mean_matches_window(spark):
    df = skewed(spark, 2000).withColumn("win", F.col("flag").cast("int"))
    got = rolling_prior_mean(df, ["grp"], ["ts", "id"], "win", n=5, out="m", bucket_rows=64).select("id", "m")
    w = Window.partitionBy("grp").orderBy("ts", "id").rowsBetween(-5, -1)
    want = df.select("id", F.least(F.greatest(F.coalesce(F.avg(F.col("win").cast("double")).over(w), F.lit(0.5)),
                                              F.lit(0.0)), F.lit(1.0)).alias("m"))
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


def test_anchor_tie_breaks_to_earlier_tick(spark):
    t = spark.createDataFrame([("a", 13, 10), ("a", 15, 20), ("b", 16, 5), ("b", 12, 7), ("c", 3, 1)],
                              "k string, t int, v int")
    out = {r.k: (r.anchor_value, r.anchor_tick) for r in nearest_anchor(t, "k", "t", "v").collect()}
    assert out == {"a": (10, 13), "b": (7, 12)}


def test_islands_and_longest_run(spark):
    rows = [("s", i, f) for i, f in enumerate([False, True, True, False, True, True, True, False])]
    df = spark.createDataFrame(rows, "k string, i int, f boolean")
    blocks = [r.block for r in bool_islands(df, "k", "i", "f").orderBy("i").collect()]
    assert blocks == [1, 2, 2, 3, 4, 4, 4, 5]
    assert max_true_run(df, "k", "i", "f", out="m").first().m == 3


def test_exact_quantiles_match_numpy_under_skew(spark):
    import numpy as np
    from playline.operators.explore import quartiles
    df = skewed(spark, 3000).withColumn("x", (F.col("id") * 37 % 1013).cast("double"))
    got = {r.grp: r for r in quartiles(df, "x", by="grp").collect()}
    data = {}
    for r in df.select("grp", "x").collect():
        data.setdefault(r.grp, []).append(r.x)
    for g, xs in data.items():
        q1, med, q3 = np.percentile(xs, [25, 50, 75])
        assert (got[g].q1, got[g].median, got[g].q3) == (q1, med, q3) and got[g].n == len(xs)
    whole = quartiles(df, "x").first()
    assert whole.median == np.percentile([r.x for r in df.select("x").collect()], 50)


def test_empty_inputs(spark):
    df = skewed(spark, 10).where("id < 0")
    assert number_rows(df, ["grp"], ["ts", "id"], out="n").count() == 0
    assert rolling_prior_mean(df.withColumn("win", F.lit(1)), ["grp"], ["ts", "id"], "win").count() == 0


def test_offset_lookup_exact_offsets(spark):
    from playline.operators.sequence import offset_lookup
    t = spark.createDataFrame([("a", 3, 30), ("a", 4, 40), ("a", 6, 60), ("a", 7, 70), ("b", 5, 5)],
                              "k string, t int, v int")
    prev = offset_lookup(t, "k", "t", "v", -1, "p")
    nxt = offset_lookup(prev, "k", "t", "v", 1, "n")
    back3 = offset_lookup(nxt, "k", "t", "v", -3, "b3", default=0)
    got = {(r.k, r.t): (r.p, r.n, r.b3) for r in back3.collect()}
    # tick 6 has no tick 5: the adjacent row (tick 4) is not a hit
    assert got == {("a", 3): (None, 40, 0), ("a", 4): (30, None, 0), ("a", 6): (None, 70, 30),
                   ("a", 7): (60, None, 40), ("b", 5): (None, None, 0)}


def test_numbering_null_groups_and_wide_values(spark):
    rows = [(None, k, 9007199254740993 + k if k % 2 else None) for k in range(5)] + [("a", k, k) for k in range(3)]
    df = spark.createDataFrame(rows, "grp string, id int, big long")
    got = number_rows(df, ["grp"], ["id"], out="n", num_partitions=3).collect()
    assert [(r.id, r.n) for r in sorted(got, key=lambda r: r.id) if r.grp is None] == [(k, k + 1) for k in range(5)]
    assert {r.big for r in got if r.grp is None and r.big is not None} == {9007199254740994, 9007199254740996}
    plan = number_rows(df, ["grp"], ["id"], out="n")._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan


def test_hot_session_is_dealt_into_buckets(spark):
    """One session holds nine tenths of all incidents; results equal the plain windows."""
    import random
    rng = random.Random(9)
    rows, t = [], 0
    for n in range(1, 901):
        t += rng.choice([1, 2, 3, 4, 9])
        rows.append(("hot", n, t, rng.random() < 0.8))
    rows += [(f"s{k}", n, 3 * n, bool((n + k) % 3)) for k in range(20) for n in range(1, 6)]
    df = spark.createDataFrame(rows, "k string, i int, v int, f boolean")
    plain = gap_flags(df, "k", "i", "v", 3)
    dealt = gap_flags(df, "k", "i", "v", 3, seq="i", bucket_rows=16)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))
    a, b = bool_islands(df, "k", "i", "f"), bool_islands(df, "k", "i", "f", seq="i", bucket_rows=16)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    a, b = max_true_run(df, "k", "i", "f"), max_true_run(df, "k", "i", "f", seq="i", bucket_rows=16)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    from playline.operators.sequence import _with_halo
    assert _with_halo(df, "i", 16).groupBy("k", "_bucket").count().agg({"count": "max"}).first()[0] == 17


def test_quantiles_bracketed_with_ties(spark):
    """Groups far larger than the accuracy, a third of a group one value, a NULL group and NULL values."""
    import random

    import numpy as np

    from playline.operators.explore import exact_quantiles
    rng = random.Random(5)
    rows = [("a", float(rng.choice([7, rng.randrange(1000), rng.random()]))) for _ in range(3000)]
    rows += [(None, float(k * k % 101)) for k in range(500)] + [("b", 4.0), ("b", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, "x", probs, "g", accuracy=50).collect()}
    for g in ("a", "b", None):
        xs = [x for k, x in rows if k == g and x is not None]
        for q in probs:
            assert abs(got[(g, q)] - np.quantile(xs, q)) < 1e-9, (g, q)
    assert len(got) == 18
