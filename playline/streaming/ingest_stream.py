"""Incremental ingest of newly landed documents with Structured Streaming (ST1).

The file source picks up only files it has not seen. Details and timelines meet
in a stream-stream full outer join: a document waits for its counterpart in
Spark's keyed state, so a batch costs what it brings, not what waits (with
many documents waiting, set the session's state store provider to RocksDB).
The time of a document is that of the batch that read it, so none is ever late;
documents of one key in one file are taken in the order of a hash of their content.
A document whose counterpart has not come within ``wait`` leaves the state
unmatched and is quarantined with its reason. ``foreachBatch`` flattens the
pairs and commits the three tables and the quarantine in one store version,
named after the batch: a replayed batch commits once.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.plans.ingest import QUARANTINE, new_rows
from playline.plans.tables import TableStore, absent_rows
from playline.sources.documents import DOC_SCHEMA, document_columns, flatten_joined, pair_documents, with_arrival, with_snapshots

WAIT = "30 days"


def document_stream(spark: SparkSession, raw_path: str, layout: str = "lines", files_per_trigger: int = 1000) -> DataFrame:
    """Streaming rows of documents: JSON Lines under raw/{detail,timeline}/<part>/
    (``lines``), or one object per file in raw/ (``files``)."""
    r = (spark.readStream.schema(DOC_SCHEMA).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record")
         .option("maxFilesPerTrigger", files_per_trigger))
    raw = (r.option("multiLine", True).option("pathGlobFilter", "*.json").json(raw_path) if layout == "files"
           else r.json(f"{raw_path.rstrip('/')}/*/*"))
    return raw.select(*document_columns(raw, layout), "metadata", "info", "_corrupt_record")


def met(docs: DataFrame, wait: str = WAIT) -> DataFrame:
    """(detail, timeline) structs of the documents of one key, or one of them
    alone once ``wait`` is over. Documents without a key wait for nothing."""
    every = docs.withColumn("at", F.current_timestamp())
    every = with_arrival(every, F.unix_micros("at"), F.xxhash64("metadata", "info"), "at")
    row = F.struct(*[c for c in every.columns if c != "at"])
    side = lambda kind, at: (every.where((F.col("kind") == kind) & F.col("doc_key").isNotNull())
                             .select(row.alias(kind), F.col("at").alias(at)).withWatermark(at, "0 seconds"))
    span = F.expr(f"INTERVAL {wait}")
    pairs = side("detail", "d_at").join(side("timeline", "t_at"), (F.col("detail.doc_key") == F.col("timeline.doc_key"))
                                        & (F.col("t_at") >= F.col("d_at") - span) & (F.col("t_at") <= F.col("d_at") + span), "full_outer")
    alone = every.where(F.col("doc_key").isNull()).select(
        *[F.when(F.col("kind") == k, row).alias(k) for k in ("detail", "timeline")])
    return pairs.select("detail", "timeline").unionByName(alone)


def process_batch(store: TableStore, batch: DataFrame, player: str | Column, tick_ms: int = 60_000, name: str | None = None) -> None:
    """Flatten and commit the (detail, timeline) rows of one micro-batch."""
    store.refresh()      # another command may have committed since the last batch
    docs = (batch.where("detail IS NOT NULL").select("detail.*")
            .unionByName(batch.where("timeline IS NOT NULL").select("timeline.*")))
    docs = docs.dropDuplicates(["kind", "arrival"]).persist(StorageLevel.MEMORY_AND_DISK)     # one row of a document that met several
    p = pair_documents(docs, player)
    joined = with_snapshots(p["joined"], tick_ms).persist(StorageLevel.MEMORY_AND_DISK)       # five writes read it
    try:
        fl = flatten_joined(joined, tick_ms)
        frames = new_rows(fl, store)
        broken = docs.where((F.col("kind") == "timeline") & F.col("doc_key").isNull()).select(
            "doc_key", "file_name", F.lit("malformed timeline").alias("reason"))
        alone = p["orphans"].where("doc_key IS NOT NULL").select(
            "doc_key", F.col("timeline_file").alias("file_name"), F.lit("detail missing").alias("reason"))
        rejected = fl["quarantine"].unionByName(broken).unionByName(alone).distinct()
        # a rejected document may meet another timeline later: it is named once
        frames |= absent_rows({QUARANTINE: rejected}, store, {QUARANTINE: ("doc_key", "file_name", "reason")})
        store.commit(frames, mode="append", name=name)
    finally:
        joined.unpersist()
        docs.unpersist()


def ingest_stream(spark: SparkSession, raw_path: str, store: TableStore, checkpoint: str, player: str | Column,
                  tick_ms: int = 60_000, every: str | None = None, layout: str = "lines", files_per_trigger: int = 1000,
                  wait: str = WAIT):
    """By default process everything landed so far (``availableNow``) and
    stop; with ``every`` (e.g. '5 minutes') keep running on a processing-time
    trigger and return the running query."""
    if player is None:
        raise ValueError("name the tracked player")
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    w = (met(document_stream(spark, raw_path, layout, files_per_trigger), wait).writeStream
         .foreachBatch(lambda df, epoch: process_batch(store, df, player, tick_ms, f"{run}-{epoch}"))
         .option("checkpointLocation", checkpoint))
    if every:
        return w.trigger(processingTime=every).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
