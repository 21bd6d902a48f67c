"""Features over session tables dealt alike (``sources/copartitioned.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playline.config import DEFAULT, AnalysisConfig
from playline.operators import features as FT
from playline.sources.copartitioned import TABLES


def stored_baselines(spark: SparkSession, tables: dict[str, DataFrame], path: str, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The per-tick baselines, written first and read back.

    They have one row per tick value. As a file their size is known when the next
    plan is made, so Spark's own size check broadcasts them and ticks are not
    dealt by tick value; if the check fails, the join shuffles as before."""
    scoped = FT.in_scope(tables["ticks"], FT.scope(tables["sessions"], cfg))
    FT.tick_baselines(scoped, cfg).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dealt_feature_matrix(spark: SparkSession, tables: dict[str, DataFrame], path: str, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The feature matrix in which no tick and no incident is exchanged for a join or
    a window by session; each session's rolling form, worked out by player, is.
    ``path``: a shared folder for the baselines."""
    base = stored_baselines(spark, tables, path, cfg)
    return FT.feature_matrix(*(tables[t] for t in TABLES), cfg, baselines=base)
