"""Scalar functions and zone independence."""

from __future__ import annotations

from pyspark.sql import functions as F

from playline.functions import scalars as S


def test_epoch_round_trip_is_zone_independent(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 01:30:00.123456",), ("2024-03-10 03:30:00",)], "t string") \
            .select(F.col("t").cast("timestamp_ntz").alias("ts"))
        r = df.select(S.to_epoch_ms("ts").alias("ms")).select("ms", S.from_epoch_ms("ms").alias("back")).collect()
        assert r[1].ms - r[0].ms == 2 * 3600 * 1000 - 123          # wall-clock difference, no DST hour lost
        assert str(r[0].back) == "2024-03-10 01:30:00.123000"
        assert r[0].ms == 1710034200123
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_text_and_version_functions(spark):
    df = spark.createDataFrame([("16.11.734.2211", 7, " Player #AB1#x ", None), ("16", 12345, "name#", "XY"),
                                ("x.y", 1, "#tag", "")], "v string, n int, h string, t string")
    r = df.select(S.major_minor("v").alias("mm"), *S.version_sort_keys("v"),
                  S.padded_id("GAME_", "n").alias("id"), S.split_handle("h", F.col("t")).alias("hd")).collect()
    assert [x.mm for x in r] == ["16.11", "16", "x.y"]
    assert [x.id for x in r] == ["GAME_0007", "GAME_12345", "GAME_0001"]
    assert (r[0].hd.name, r[0].hd.tag) == ("Player", "AB1#x")
    assert (r[1].hd.name, r[1].hd.tag) == ("name", "XY")
    assert (r[2].hd.name, r[2].hd.tag) == (None, "tag")
    assert [tuple(x)[1:3] for x in r] == [(16, 11), (16, None), (None, None)]


def test_numeric_functions(spark):
    df = spark.createDataFrame([(1, 0, 3, 600, None), (2, 5, 0, 0, 4)], "k int, d int, a int, dur int, od int")
    r = df.select(S.kda("k", "d", "a").alias("kda"), S.kda("k", "od", "a").alias("okda"),
                  S.per_minute("a", "dur").alias("pm"), S.round_half_even(F.lit(1 / 32), 4).alias("b"),
                  S.safe_ratio("k", "d").alias("r"), S.time_bucket(F.lit(23)).alias("tb"),
                  S.cut(F.lit(0.6), [0, .2, .4, .6, .8, 1.01], ["a", "b", "c", "d", "e"]).alias("c")).collect()
    assert r[0].kda == 4.0 and r[0].okda is None and r[1].okda == 0.5
    assert r[0].pm == 0.3 and r[1].pm == 0.0
    assert r[0].b == 0.0312 and r[0].r == 0.0 and r[1].r == 0.4
    assert r[0].tb == "night" and r[0].c == "d"
