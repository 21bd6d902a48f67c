"""Batch ingest of landed documents into the session tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.plans.tables import TableStore, absent_rows, ensure_tables
from playline.schemas import PRIMARY_KEYS
from playline.sources.documents import flatten_joined, pair_documents, read_documents, with_snapshots

TABLES = ("sessions", "ticks", "incidents")
QUARANTINE = "quarantine"


def new_rows(frames: dict[str, DataFrame], store: TableStore) -> dict[str, DataFrame]:
    """K1: the rows that the three tables do not hold yet, table by table: a
    longer re-parse of a stored session adds its new ticks and incidents."""
    # each session at hand has its row in ``sessions``: the other tables need not be read for the ids
    return absent_rows({t: frames[t] for t in TABLES}, store, PRIMARY_KEYS, frames["sessions"].select("match_id"))


def ingest(spark: SparkSession, raw_path: str, store: TableStore, player: str | Column, tick_ms: int = 60_000,
           layout: str = "lines", mode: str = "incremental") -> dict:
    """Read every landed document, flatten, and commit the three tables and the
    quarantine at once.

    ``incremental``: rows already stored are ignored, table by table (first
    write wins, re-running is a no-op). ``full``: rebuild all three tables from the
    immutable raw documents into a new version. The quarantine holds the
    rejected documents of the latest run, each with its reason.
    """
    if mode not in ("incremental", "full"):
        raise ValueError("mode must be 'incremental' or 'full'")
    ensure_tables(store)       # create-if-absent + column contracts, before any write
    p = pair_documents(read_documents(spark, raw_path, layout), player)
    # the paired documents (only the fields of the tables) feed all writes and the summary: parse and pair once
    joined = with_snapshots(p["joined"], tick_ms).persist(StorageLevel.MEMORY_AND_DISK)
    fl = flatten_joined(joined, tick_ms)
    try:
        frames = new_rows(fl, store) if mode == "incremental" else {t: fl[t] for t in TABLES}
        version = store.commit(frames | {QUARANTINE: fl["quarantine"]},
                               mode="append" if mode == "incremental" else "replace", replace=(QUARANTINE,))
        counts = joined.agg(F.count_if(F.col("_reason").isNull()), F.count_if(F.col("_reason").isNotNull())).first()
        summary = spark.createDataFrame([(counts[0], counts[1], store.read("sessions").count())],
                                        "processed long, skipped long, total_rows long")
        return {"version": version, "summary": summary, "quarantine": store.read(QUARANTINE), "orphans": p["orphans"]}
    finally:
        joined.unpersist()
