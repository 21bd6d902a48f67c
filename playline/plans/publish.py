"""Pseudonymised publishing of the analysis scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.config import DEFAULT, AnalysisConfig
from playline.functions.scalars import padded_id
from playline.operators.features import scope
from playline.operators.sequence import number_rows
from playline.plans.tables import TableStore
from playline.schemas import FEATURE_MATRIX_COLUMNS, SESSION_COLUMNS, assert_columns

# Surrogate key format.
SURROGATE_PREFIX = "GAME_"
SURROGATE_WIDTH = 4
PUBLISHED_SESSION_COLUMNS = tuple(c for c in SESSION_COLUMNS if c != "puuid")


class EmptyScopeError(ValueError):
    """Nothing to publish in the analysis scope."""


def surrogate_ids(scoped: DataFrame, order=("game_datetime", "match_id")) -> DataFrame:
    """id map: original key -> GAME_0001... numbered in global time order.

    ``number_rows`` range-partitions on the order key and adds per-partition
    offsets, so the numbering never pulls the table into one partition; the
    id tie-break makes it deterministic when start times are equal."""
    numbered = number_rows(scoped.select("match_id", *[c for c in order if c != "match_id"]), [], list(order),
                           out="_n")
    return numbered.select(F.col("match_id").alias("original_match_id"),
                           padded_id(SURROGATE_PREFIX, "_n", SURROGATE_WIDTH).alias("surrogate_match_id"))


def rekey(df: DataFrame, id_map: DataFrame, key: str = "match_id") -> DataFrame:
    """Replace the key through the id map (inner join, so rows outside
    the published scope are dropped); column order preserved."""
    j = df.join(id_map, df[key] == id_map["original_match_id"])
    return j.select(*[F.col("surrogate_match_id").alias(key) if c == key else df[c] for c in df.columns])


def publish_frames(tables: dict[str, DataFrame], cfg: AnalysisConfig = DEFAULT,
                   coarsen_time: str | None = None) -> dict[str, DataFrame]:
    """The five published tables as DataFrames (nothing written yet).

    ``coarsen_time`` (e.g. 'hour', 'day') truncates start times, the residual
    re-identification risk of exact timestamps."""
    sessions = tables["sessions"]
    scoped = scope(sessions, cfg)
    if scoped.isEmpty():
        raise EmptyScopeError("No sessions found in the analysis scope.")
    assert_columns(tables["feature_matrix"], "feature_matrix", FEATURE_MATRIX_COLUMNS)
    id_map = surrogate_ids(scoped)
    out = {
        "sessions": rekey(scoped.select(*PUBLISHED_SESSION_COLUMNS), id_map),
        "ticks": rekey(tables["ticks"], id_map),
        "incidents": rekey(tables["incidents"], id_map),
        "feature_matrix": rekey(tables["feature_matrix"].select(*FEATURE_MATRIX_COLUMNS), id_map),
        "cluster_labels": rekey(tables["cluster_labels"].select("match_id", "cluster_id"), id_map),
    }
    if coarsen_time:
        for name in ("sessions", "feature_matrix"):
            out[name] = out[name].withColumn("game_datetime", F.date_trunc(coarsen_time, "game_datetime")
                                             .cast(out[name].schema["game_datetime"].dataType))
    return out


def publish(spark: SparkSession, tables: dict[str, DataFrame], out_root: str, cfg: AnalysisConfig = DEFAULT,
            coarsen_time: str | None = None) -> TableStore:
    """Write the published tables as one new store version; if anything fails
    before the manifest is written, readers still see no (partial) version."""
    frames = publish_frames(tables, cfg, coarsen_time)
    store = TableStore(spark, out_root)
    store.commit(frames, mode="replace")
    return store


def publish_counts(store: TableStore) -> DataFrame:
    from playline.operators.reports import table_counts
    return table_counts({t: store.read(t) for t in ("sessions", "ticks", "incidents", "feature_matrix",
                                                     "cluster_labels")})
