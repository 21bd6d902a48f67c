"""Connected components of an edge table by alternating large and small stars.

Each round writes its edges and minima to the shared folder, so lineage stays
short, a lost executor costs one stage, and both join sides are plain scans, whose hot
keys (the centre of a large star) adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playline.llm.common import stored


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node on an edge (u, v: long); root is the least node of its component."""
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-min")
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .filter("u <> v").distinct(), "cc-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
