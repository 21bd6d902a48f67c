"""Findings of round 3: the input is built and derived once, and no driver lists files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from playline.checks import landing_docs as LD
from playline.config import ADAPTER as CFG
from playline.operators import clustering as CL
from playline.plans import catalog
from playline.plans.tables import TableStore, absent_rows
from playline.sources import adapter, documents as D

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("events"))
    kinds = ("view", "purchase", "error", "click", "signup", "error")
    rows = [(i, f"2024-01-{1 + (i * 7) % 20:02d} {i % 24:02d}:{i % 60:02d}:00", i * 5 % 9 if i % 11 else None, kinds[i % 6],
             i / 4, json.dumps({"k": i % 100})) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{sf}/events.parquet")
    return sf


def tables(spark, folder):
    return dict(zip(("sessions", "ticks", "incidents"), catalog.T3(spark, folder)))


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_scope_sessions_derives_sessions_alone(spark, folder):
    catalog.QUERIES["scope_sessions"](spark, folder).count()
    key = next(k for k in catalog._MATERIALISED if k[1] == folder)
    assert set(catalog._MATERIALISED[key]) == {"", "sessions"}


def test_rival_is_the_neighbour_of_the_same_block(spark, folder):
    rows = {r.match_id: r for r in adapter.sessions(adapter.load_events(spark, folder)).collect()}
    assert any(r.opp_cs_total is not None for r in rows.values())
    for r in rows.values():
        user, _, block = r.match_id.partition("-")
        other = rows.get(f"{int(user) ^ 1}-{block}") if block else None
        want = (None,) * 2 if other is None else (other.cs_total, other.kills)
        assert (r.opp_cs_total, r.opp_kills) == want


def test_documents_are_built_with_a_shuffle_for_each_table(spark, folder):
    t = tables(spark, folder)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert exchanges(LD.timeline_documents(t["sessions"], t["ticks"], t["incidents"], CFG.tick_ms)) <= 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_defects_are_edits_of_what_landed(spark, folder, tmp_path):
    path = LD.write_defects(LD.write_landing(tables(spark, folder), str(tmp_path / "raw"), CFG.tick_ms))
    n = tables(spark, folder)["sessions"].count()
    for kind, at in (("detail", 0), ("timeline", 1)):
        per_session = sum(edit[at] is not None for edit in LD.DEFECTS.values())
        assert spark.read.text(f"{path}/{kind}/defects").count() == n * per_session


def test_a_rejected_document_has_no_frames_parsed(spark, folder, tmp_path):
    path = LD.write_defects(LD.write_landing(tables(spark, folder), str(tmp_path / "raw"), CFG.tick_ms))
    joined = D.pair_documents(D.read_documents(spark, path, "lines"), F.split("metadata.matchId", "-")[0])["joined"]
    assert joined.where("_reason IS NOT NULL AND _fr IS NOT NULL").count() == 0
    assert joined.where("_reason IS NULL AND size(_fr) > 0").count() > 0


def test_a_rejected_document_goes_on_without_its_players(spark, folder, tmp_path):
    path = LD.write_defects(LD.write_landing(tables(spark, folder), str(tmp_path / "raw"), CFG.tick_ms))
    joined = D.pair_documents(D.read_documents(spark, path, "lines"), F.split("metadata.matchId", "-")[0])["joined"]
    detail = "_reason IN ('missing required field', 'participant id missing')"
    assert joined.where(detail).count() > 0 and joined.where(f"{detail} AND own IS NOT NULL").count() == 0
    assert joined.where("_reason IS NULL AND own IS NULL").count() == 0


def test_who_asks_for_details_reads_no_timeline(spark, folder, tmp_path):
    path = LD.write_landing(tables(spark, folder), str(tmp_path / "raw"), CFG.tick_ms)
    docs = D.read_documents(spark, path, "lines")
    for kind, other in (("detail", "timeline"), ("timeline", "detail")):
        files = docs.where(F.col("kind") == kind).inputFiles()
        assert files and not any(f"/{other}/" in f for f in files)


def test_ticks_are_moved_by_tick_and_by_session_alone(spark, folder):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert exchanges(adapter.ticks(adapter.load_events(spark, folder))) <= 3    # parts, errors, window
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_errors_after_the_last_other_event_of_a_tick_are_taken_off(spark):
    at = "2024-01-01 00:0{}:00"
    rows = [(1, at.format(1), 4, "view", 1.0, '{"k": 3}'), (2, at.format(2), 4, "error", 2.0, None), (3, at.format(2), 4, "click", 4.0, None),
            (4, at.format(2), 4, "error", 8.0, None), (5, at.format(3), 4, "error", 16.0, None), (6, "2024-01-01 07:00:00", 4, "error", 32.0, None),
            (7, "2024-01-01 13:00:00", 4, "purchase", 64.0, '{"k": 2}'), (None, None, 4, "error", 1.0, None), (8, None, None, "view", None, None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    got = {(r.match_id, r.timestamp_min): (r.gold, r.cs, r.xp, r.kills, r.position_x) for r in adapter.ticks(
        events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()}
    assert got == {("4-0", 0): (700, 2, 3, 0, None), ("4-0", 2): (12700, 2, 7, 1, 300), ("", None): (None, 1, 1, 0, None)}


@pytest.mark.parametrize("texts, want", [
    (None, None), ([], []), (['{"killerId":1}', ' {"killerId":2.0,"x":[{}]}'], [1, 2]), (['{"killerId":1}', "stray", None, "", "7"], [1]),
    (['{"killerId":"1"}', '{"killerId":2}'], [None, 2]), (['{"killerId":1},{"killerId":2', '"x":3}'], [1]), (['{"killerId":1', '{"x":2}}'], [None, None])])
def test_elements_that_fit_are_parsed_in_one_go(spark, texts, want):
    rows = spark.createDataFrame([(texts,)], "texts array<string>")
    schema = D._loose(D.EVENT)
    out = D.with_objects(rows, "texts", "out", schema, lambda x: D.loose_part(x, D.EVENT)).first()["out"]
    each = rows.select(D.parsed_each(F.col("texts"), D.EVENT).alias("out")).first()["out"]
    got = None if out is None else [e.killerId for e in out if e is not None]
    assert got == want and (got is None or got == [e.killerId for e in each])


def test_nothing_is_compared_with_empty_tables(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1)], "match_id string, n int")
    store.commit({"t": rows.limit(0)})
    store.refresh()
    assert absent_rows({"t": rows}, store, {"t": ("match_id", "n")})["t"] is rows
    store.commit({"t": rows})
    assert absent_rows({"t": rows}, store, {"t": ("match_id", "n")})["t"].count() == 0


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for name, text in (("a/M1.json", '{"metadata":\n {"matchId": "M1"}}'), ("M1_timeline.json", '{"info": {"frames": []}}'),
                       ("b/c/M2.json", '{"metadata"'), ("b/M3.json", ""), ("_x.json", "{}"), ("M4.txt", "{}"),
                       ("M5.json", ' [{"metadata":{"matchId":"M5"}}, {"metadata":{"matchId":"M6"}}]')):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = D.read_documents(spark, str(tmp_path), "files")
    assert not docs.inputFiles()
    got = sorted((r.doc_key, r.kind, r.metadata.matchId if r.metadata else None, r._corrupt_record is not None) for r in docs.collect())
    assert got == [("M1", "detail", "M1", False), ("M1", "timeline", None, False), ("M2", "detail", None, True),
                   ("M5", "detail", "M5", False), ("M5", "detail", "M6", False)]


@pytest.mark.parametrize("text, want", [("{}", ["{}"]), ("[]", []), ("[1, {}]", ["1", "{}"]), ("[{},", ["[{},"]), ("[{} {}]", ["[{} {}]"]), ("[{},]", ["[{},]"])])
def test_elements_of_a_file(text, want):
    assert D._elements(text) == want


def test_a_pass_shuffles_sums_not_rows(spark):
    points = spark.createDataFrame([(str(i), [float(i % 7), float(i % 3)]) for i in range(50)], "match_id string, p array<double>").repartition(3)
    centers = {0: [[0.0, 0.0], [6.0, 2.0], [99.0, 99.0]], 4: [[3.0, 1.0], [3.0, 1.0]]}
    got = {(r["r"], r["c"]): (r["n"], list(r["s"])) for r in CL._cluster_sums(points, centers)}
    want = {}
    for r, cs in centers.items():
        for i in range(50):
            p = (float(i % 7), float(i % 3))
            c = min(range(len(cs)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(p, cs[j])), j))
            n, s = want.get((r, c), (0, [0.0, 0.0]))
            want[r, c] = (n + 1, [a + b for a, b in zip(s, p)])
    assert got == want


def test_places_key_the_links_of_a_batch(monkeypatch):
    import numpy as np
    from playline.llm import alignment as A
    keyed, plain = [], A.pd.merge_asof
    monkeypatch.setattr(A.pd, "merge_asof", lambda a, b, **kw: (keyed.append("by" in kw), plain(a, b, **kw))[1])
    doc, a_at, b_at = np.array([0, 0, 1, 1]), np.array([0, 3, 5, 8]), np.array([0, 2, 5, 6])
    assert sorted(zip(*(x.tolist() for x in A.links(doc, a_at, doc, b_at)))) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)]
    assert keyed == [False, False]
