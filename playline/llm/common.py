"""Shared expressions of the training-data operators (JVM side only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.session import shared_path

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(col: Column) -> Column:
    """Array of words: maximal runs outside the six ASCII white-space characters."""
    return F.array_remove(F.split(col, WS), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives
    a lost executor, and lets two consumers share one computation. ``options``: of the Parquet writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
