"""Mixing sources to target weights by pivotal dependent rounding.

A source with word total ``S`` and word target ``T`` repeats each of its
documents ``floor(T/S)`` times and once more with probability ``frac(T/S)``.
The extra copies are drawn dependently: two documents with fractional
probabilities trade word mass, at random but fair in expectation, until one of
them is settled at 0 or 1. Buckets of about ``FANOUT`` documents are settled
side by side; each leaves one fractional residual, residuals meet in buckets of
the next level, and so on up a tree of logarithmic height to one per source,
which is rounded by its own probability. Words taken therefore differ from the
target by at most the words of one document (all rows of one repeated document
share a draw and count as one).

Targets fill by water level: weights share 150 % of all words, no source above
twice its own, the excess shared again by weight.

Defined cases: null or blank text has size 0 and takes 0; a null source is a
source, last in order; null ids are ordinary; equal (id, source, size) rows share
one draw; an empty table gives no rows; the draw is a hash of ids and seed, so
reruns agree; extra columns are kept by ``copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from playline.llm.common import WORD, documents, let, stored, text_of

FANOUT, SEED, SHARE, CAP = 256, 20240607, 1.5, 2.0
WEIGHTS = (5.0, 2.0, 1.0)  # repeat over the sources in code-point order
ITEM = "struct<id:bigint,size:bigint,mass:double,q:double>"
DONE = "array<struct<id:bigint,size:bigint,up:int>>"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: total, target, whole copies, extra-copy probability.

    The windows run over the per-source totals only (one row per source)."""
    one = F.lit(0)
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    t = t.withColumn("weight", w[F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))])
    t = t.withColumn("cap", F.lit(CAP) * F.col("source_size"))
    fill = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    above = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(one)
    t = t.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(whole)
                               - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    # the water level is that of the first source which it does not fill; after it the values fall
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(whole))
    t = t.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (t.withColumn("whole", F.floor(p).cast("long"))
            .withColumn("frac", p - F.floor(p))
            .select("source", "source_size", "target", "whole", "frac"))


def _u(level: int, *keys) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + level), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _settle(items: Column, level: int, source: Column) -> Column:
    """Trade mass along ``items`` (array of ITEM): struct(cur = residual item, out = settled)."""
    item = lambda i, q: F.struct(i["id"].alias("id"), i["size"].alias("size"), i["mass"].alias("mass"),
                                 q.alias("q")).cast(ITEM)
    done = lambda i, up: F.array(F.struct(i["id"].alias("id"), i["size"].alias("size"),
                                          F.lit(up).alias("up"))).cast(DONE)
    state = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out"))

    def trade(a, x):
        c = a["cur"]
        rooms = F.struct(((1 - c["q"]) * c["mass"]).alias("cu"), (c["q"] * c["mass"]).alias("cd"),
                         ((1 - x["q"]) * x["mass"]).alias("xu"), (x["q"] * x["mass"]).alias("xd"))

        def move(r):
            up, down = F.least(r["cu"], r["xd"]), F.least(r["cd"], r["xu"])
            rise = _u(level, source, c["id"], x["id"], c["size"], x["size"]) * (up + down) < down
            return (F.when(rise & (r["cu"] <= r["xd"]),
                           state(item(x, (r["xd"] - r["cu"]) / x["mass"]), F.concat(a["out"], done(c, 1))))
                    .when(rise, state(item(c, (r["cd"] + r["xd"]) / c["mass"]), F.concat(a["out"], done(x, 0))))
                    .when(r["cd"] <= r["xu"],
                          state(item(x, (r["xd"] + r["cd"]) / x["mass"]), F.concat(a["out"], done(c, 0))))
                    .otherwise(state(item(c, (r["cd"] - r["xu"]) / c["mass"]), F.concat(a["out"], done(x, 1)))))

        return let(rooms, move)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))),
                       state(items[0].cast(ITEM), F.array().cast(DONE)), trade)


def _level(items: DataFrame, level: int) -> DataFrame:
    """items: (source, bucket, id, size, mass, q) -> one settled row per (source, bucket)."""
    g = (items.groupBy("source", "bucket")
         .agg(F.sort_array(F.collect_list(F.struct("id", "size", "mass", "q"))).alias("_items")))
    g = g.withColumn("_r", _settle(F.col("_items"), level, F.col("source")))
    return stored(g.select("source", "bucket", F.col("_r.cur").alias("cur"), F.col("_r.out").alias("out")),
                  f"mix-level{level}")


def draw(sized: DataFrame, goal: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, source, size, up): the extra copy of each distinct document row of size > 0."""
    one = sized.filter("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    buckets = max(1, math.ceil(sized.count() / fanout))
    items = (one.join(goal, one["source"].eqNullSafe(goal["source"]))
             .select(one["source"], F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(buckets)).alias("bucket"),
                     F.col("doc_id").alias("id"), "size", (F.col("size") * F.col("rows")).cast("double").alias("mass"),
                     F.col("frac").alias("q")))
    levels = [_level(items, 0)]
    while buckets > 1:
        buckets = math.ceil(buckets / fanout)
        up = levels[-1].select("source", F.floor(F.col("bucket") / fanout).cast("long").alias("bucket"),
                               F.col("bucket").alias("id"), "cur.size", "cur.mass", "cur.q")
        levels.append(_level(up, len(levels)))
    # unwind: the residual of a bucket gets what its item got one level above
    above = None
    for k in reversed(range(len(levels))):
        lv = levels[k]
        if above is None:
            lv = lv.withColumn("up", (_u(-1, "source", "cur.id", "cur.size") < F.col("cur.q")).cast("int"))
        else:
            a = above.select(F.col("source").alias("_s"), F.col("id").alias("bucket"), "up")
            lv = (lv.join(a, lv["source"].eqNullSafe(a["_s"]) & (lv["bucket"] == a["bucket"]))
                  .select(lv["source"], lv["bucket"], "cur", "out", "up"))
        last = F.array(F.struct(F.col("cur.id").alias("id"), F.col("cur.size").alias("size"), F.col("up"))).cast(DONE)
        above = lv.select("source", F.explode(F.concat("out", last)).alias("_x")).select("source", "_x.id", "_x.size", "_x.up")
    return above.withColumnRenamed("id", "doc_id")


def mix(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every row of ``docs``."""
    sized = stored(sizes(docs), "mix-sizes")
    goal = stored(targets(sized), "mix-targets")
    d = draw(sized, goal, fanout).select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"),
                                         F.col("size").alias("_z"), "up")
    rows = sized.join(d, sized["doc_id"].eqNullSafe(d["_i"]) & sized["source"].eqNullSafe(d["_s"])
                      & (sized["size"] == d["_z"]), "left").drop("_i", "_s", "_z")
    g = goal.withColumnRenamed("source", "_s")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return (rows.join(g, rows["source"].eqNullSafe(g["_s"]))
            .select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def copies(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it was taken, with its own columns."""
    m = (mix(docs).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("n"))
         .select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "n"))
    d = docs.select(F.struct("*").alias("_doc"), "doc_id", "source",
                    F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    return (d.join(m, d["doc_id"].eqNullSafe(m["i"]) & d["source"].eqNullSafe(m["s"]) & (d["size"] == m["z"]))
            .select("_doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("_doc.*"))
