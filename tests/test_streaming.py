"""Structured Streaming ingest: a detail and its timeline landing in different batches."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from playline.plans.tables import TableStore
from playline.streaming.ingest_stream import ingest_stream
from tests.test_ingest import PLAYER, detail, timeline


def put(root, kind, part, name, obj):
    d = os.path.join(root, kind, part)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as fh:
        fh.write(json.dumps(obj) + "\n")


def test_pending_documents_are_paired_later(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    raw, store, ckpt = f"{base}/raw", TableStore(spark, f"{base}/store"), f"{base}/ckpt"
    t2 = timeline()
    t2["metadata"]["matchId"] = "M2"
    put(raw, "detail", "p1", "a.json", detail("M1"))
    put(raw, "detail", "p1", "b.json", detail("M2"))
    put(raw, "timeline", "p1", "a.json", timeline())
    ingest_stream(spark, raw, store, ckpt, PLAYER)
    assert {r.match_id for r in store.read("sessions").collect()} == {"M1"}
    assert store.read("quarantine").count() == 0          # M2 waits in the state
    n_ticks = store.read("ticks").count()

    put(raw, "timeline", "p2", "b.json", t2)              # the late timeline
    ingest_stream(spark, raw, store, ckpt, PLAYER)
    assert {r.match_id for r in store.read("sessions").collect()} == {"M1", "M2"}
    assert store.read("ticks").count() == 2 * n_ticks

    ingest_stream(spark, raw, store, ckpt, PLAYER)       # nothing new: no change
    assert store.read("sessions").count() == 2


def test_rejected_documents_are_kept_with_their_reason(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    raw, store, ckpt = f"{base}/raw", TableStore(spark, f"{base}/store"), f"{base}/ckpt"
    put(raw, "detail", "p1", "a.json", detail("M1", player="someone-else"))
    put(raw, "timeline", "p1", "a.json", timeline())
    put(raw, "detail", "p1", "b.json", detail("M2"))
    ingest_stream(spark, raw, store, ckpt, PLAYER)
    assert [(r.doc_key, r.reason) for r in store.read("quarantine").collect()] == [("M1", "player not found")]
    put(raw, "detail", "p2", "c.json", detail("M1"))      # the right player, after the rejected one
    put(raw, "timeline", "p2", "c.json", timeline())
    ingest_stream(spark, raw, store, ckpt, PLAYER)
    assert store.read("sessions").count() == 1 and store.read("quarantine").count() == 1


def test_files_layout(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    raw, store = f"{base}/raw", TableStore(spark, f"{base}/store")
    os.makedirs(raw)
    for name, obj in (("M1.json", detail("M1")), ("M1_timeline.json", timeline()), ("M2.json", detail("M2"))):
        with open(f"{raw}/{name}", "w") as fh:
            json.dump(obj, fh, indent=1)
    ingest_stream(spark, raw, store, f"{base}/ckpt", PLAYER, layout="files")
    assert {r.match_id for r in store.read("sessions").collect()} == {"M1"}
    with open(f"{raw}/M2_timeline.json", "w") as fh:
        json.dump(timeline() | {"metadata": {"matchId": "M2"}}, fh)
    ingest_stream(spark, raw, store, f"{base}/ckpt", PLAYER, layout="files")
    assert {r.match_id for r in store.read("sessions").collect()} == {"M1", "M2"}


def test_replay_changes_nothing(spark):
    from playline.sources.documents import DOC_SCHEMA, document_columns, with_arrival
    from playline.streaming.ingest_stream import process_batch
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    raw, store = f"{base}/raw", TableStore(spark, f"{base}/store")
    put(raw, "detail", "p1", "a.json", detail("M1"))
    put(raw, "timeline", "p1", "a.json", timeline())
    put(raw, "detail", "p1", "b.json", detail("M2", player="someone-else"))
    docs = spark.read.schema(DOC_SCHEMA).json(f"{raw}/*/*")
    docs = with_arrival(docs.select(*document_columns(docs, "lines"), "metadata", "info", "_corrupt_record"))
    row = F.struct(*docs.columns)
    batch = docs.select(*[F.when(F.col("kind") == k, row).alias(k) for k in ("detail", "timeline")])
    for _ in range(2):
        process_batch(store, batch, PLAYER, name="run-0")
        assert store.read("sessions").count() == 1 and store.read("ticks").count() == 4
        assert store.read("quarantine").count() == 1 and store.version() == 1


def test_documents_three_batches_apart_give_the_batch_result(spark):
    from playline.plans.ingest import ingest
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    raw, store, whole = f"{base}/raw", TableStore(spark, f"{base}/store"), TableStore(spark, f"{base}/whole")
    keys = [f"M{k}" for k in range(3)]
    for k, key in enumerate(keys):
        put(raw, "detail", f"p{k % 2}", f"{key}.json", detail(key))
    ingest_stream(spark, raw, store, f"{base}/ckpt", PLAYER)
    assert store.read("sessions").count() == 0
    for part in ("q0", "q1", "q2"):                       # one file a batch; the other documents go on waiting
        for key in keys[int(part[1])::3]:
            put(raw, "timeline", part, f"{key}.json", timeline() | {"metadata": {"matchId": key}})
        ingest_stream(spark, raw, store, f"{base}/ckpt", PLAYER, files_per_trigger=1)
    ingest(spark, raw, whole, PLAYER)
    for t in ("sessions", "ticks", "incidents"):
        assert sorted(map(str, store.read(t).collect())) == sorted(map(str, whole.read(t).collect()))
    assert store.read("sessions").count() == 3


def test_what_waited_too_long_is_quarantined_with_its_reason(spark):
    import time
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    raw, store, go = f"{base}/raw", TableStore(spark, f"{base}/store"), {"wait": "1 seconds"}
    put(raw, "detail", "p1", "a.json", detail("M1"))
    put(raw, "timeline", "p1", "b.json", timeline() | {"metadata": {"matchId": "M2"}})
    ingest_stream(spark, raw, store, f"{base}/ckpt", PLAYER, **go)
    for k in (3, 4):
        time.sleep(3)
        put(raw, "detail", f"p{k}", "c.json", detail(f"M{k}"))
        put(raw, "timeline", f"p{k}", "c.json", timeline() | {"metadata": {"matchId": f"M{k}"}})
        ingest_stream(spark, raw, store, f"{base}/ckpt", PLAYER, **go)
    got = {(r.doc_key, r.reason) for r in store.read("quarantine").collect()}
    assert got == {("M1", "timeline missing"), ("M2", "detail missing")}
    assert {r.match_id for r in store.read("sessions").collect()} == {"M3", "M4"}
