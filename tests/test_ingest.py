"""Document ingest on small hand-written documents (one JSON object per file)."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from playline.plans.ingest import ingest
from playline.plans.tables import TableStore
from playline.schemas import SchemaContractError, assert_columns, SESSION_COLUMNS
from playline.sources import documents as D

PLAYER = "player-1"


def participant(pid, puuid, team, pos, champ, win, k, d, a, cs, ncs, gold, ipos=None):
    return {"puuid": puuid, "participantId": pid, "teamId": team, "teamPosition": pos,
            "individualPosition": ipos if ipos is not None else pos, "lane": pos, "championId": pid,
            "championName": champ, "win": win, "kills": k, "deaths": d, "assists": a,
            "totalMinionsKilled": cs, "neutralMinionsKilled": ncs, "goldEarned": gold,
            "totalDamageDealtToChampions": 1000 * pid, "visionScore": 13}


def detail(match_id, deaths=7, player=PLAYER):
    parts = [participant(1, "ally", 100, "TOP", "Foxtrot", False, 1, 1, 1, 10, 0, 5000),
             participant(2, "enemy-top", 200, "TOP", "Golf", True, 2, 2, 2, 20, 0, 6000),
             participant(3, "enemy-mid", 200, "", "Echo", True, 14, 1, 4, 180, 7, 15729, ipos="MIDDLE"),
             participant(8, player, 100, "MIDDLE", "Delta", False, 5, deaths, 4, 200, 21, 10976)]
    return {"metadata": {"matchId": match_id, "participants": [p["puuid"] for p in parts]},
            "info": {"gameCreation": 1768478400123, "gameVersion": "16.11.734.2211", "gameDuration": 1522,
                     "queueId": 420, "participants": parts}}


def frame(ts, snap=None, events=()):
    pf = {"3": {"totalGold": 1, "minionsKilled": 1, "jungleMinionsKilled": 0, "xp": 1}}
    if snap is not None:
        pf["8"] = snap
    return {"timestamp": ts, "participantFrames": pf, "events": list(events)}


def snap(gold, cs, xp, x=None, y=None):
    s = {"totalGold": gold, "minionsKilled": cs, "jungleMinionsKilled": 2, "xp": xp}
    if x is not None:
        s["position"] = {"x": x, "y": y}
    return s


def kill(killer, victim, ts):
    return {"type": "CHAMPION_KILL", "killerId": killer, "victimId": victim, "timestamp": ts}


def timeline():
    return {"metadata": {"matchId": "M1"}, "info": {"frames": [
        frame(0, snap(500, 0, 0, 14321, 14673)),
        frame(60_000, snap(700, 5, 100, 1, 2), [kill(8, 3, 50_000), {"type": "WARD_PLACED"}]),
        frame(119_000, snap(800, 6, 150), [kill(3, 8, 119_500)]),     # minute 1 again: stale
        frame(120_500, None, [kill(8, 1, 120_600)]),                   # no snapshot, but a kill
        frame(180_000, snap(1200, 9, 300, 5, 6), [kill(3, 8, 181_000), kill(2, 8, 182_000)]),
        frame(300_000, snap(1500, 12, 500, 7, 8)),                      # minute 4 is missing
    ]}}


@pytest.fixture(scope="module")
def landed(spark):
    root = tempfile.mkdtemp(prefix="docs-", dir=os.environ.get("PLAYLINE_SCRATCH", "/tmp"))

    def put(name, obj):
        with open(os.path.join(root, name), "w") as fh:
            fh.write(json.dumps(obj, indent=2) if not isinstance(obj, str) else obj)

    put("M1.json", detail("M1"))
    put("M1_timeline.json", timeline())
    put("M2.json", detail("M2", deaths=0))                            # no timeline yet
    put("M3_timeline.json", {"metadata": {"matchId": "M3"}, "info": {"frames": []}})   # orphan
    put("M4.json", detail("M4", player="someone-else"))              # player absent
    put("M4_timeline.json", timeline())
    put("M5.json", '{"metadata": {"matchId": "M5"}, "info": {"gameCreation": 17')      # truncated
    put("M5_timeline.json", timeline())
    t6 = timeline()
    t6["info"]["frames"] = {"not": "a list"}
    put("M6.json", detail("M6"))
    put("M6_timeline.json", t6)
    return root


def test_flatten_documents(spark, landed):
    out = D.flatten(D.read_documents(spark, landed, "files"), PLAYER, 60_000)
    s = out["sessions"].collect()
    assert [r.match_id for r in s] == ["M1"]
    r = s[0]
    assert r.game_version == "16.11" and r.champion_name == "Delta" and r.team_position == "MIDDLE"
    assert (r.kills, r.deaths, r.assists, r.cs_total) == (5, 7, 4, 221)
    assert (r.opp_champion_name, r.opp_cs_total, r.opp_kills) == ("Echo", 187, 14)
    assert r.kda == pytest.approx(9 / 7) and r.cs_per_min == pytest.approx(221 / (1522 / 60))
    assert str(r.game_datetime) == "2026-01-15 12:00:00.123000"

    ticks = [t.asDict() for t in out["ticks"].orderBy("timestamp_min").collect()]
    # minute 2 holds only a snapshot-less frame, minute 4 is missing
    assert [t["timestamp_min"] for t in ticks] == [0, 1, 3, 5]
    assert ticks[0] == {"match_id": "M1", "timestamp_min": 0, "gold": 500, "cs": 2, "xp": 0, "kills": 0,
                        "position_x": 14321, "position_y": 14673}
    assert ticks[1]["gold"] == 800 and ticks[1]["position_x"] is None   # last frame of the minute wins
    # kills count the frame without a snapshot too (running total in array order)
    assert [t["kills"] for t in ticks] == [0, 1, 2, 2]

    inc = [d.asDict() for d in out["incidents"].orderBy("death_number").collect()]
    assert [(d["death_number"], d["timestamp_min"]) for d in inc] == [(1, 1), (2, 3), (3, 3)]
    assert inc[0]["gold_at_death"] == 800 and inc[1]["gold_at_death"] == 1200

    q = {r.doc_key: r.reason for r in out["quarantine"].collect()}
    assert q["M2"] == "timeline missing" and q["M4"] == "player not found"
    assert q["M5"] == "malformed document" and q["M6"] == "malformed timeline"
    assert [r.doc_key for r in out["orphans"].collect()] == ["M3"]


def test_ingest_idempotent_and_summary(spark, landed):
    store = TableStore(spark, tempfile.mkdtemp(prefix="store-", dir="/tmp"))
    first = ingest(spark, landed, store, PLAYER, layout="files")["summary"].first()
    assert (first.processed, first.skipped, first.total_rows) == (1, 4, 1)
    n = {t: store.read(t).count() for t in ("sessions", "ticks", "incidents")}
    ingest(spark, landed, store, PLAYER, layout="files")
    assert {t: store.read(t).count() for t in ("sessions", "ticks", "incidents")} == n
    full = ingest(spark, landed, store, PLAYER, layout="files", mode="full")
    assert full["version"] == 4 and store.read("ticks").count() == n["ticks"]   # v1 = empty tables


def test_column_contract_error_text(spark):
    df = spark.createDataFrame([tuple(["x"] * (len(SESSION_COLUMNS) - 1))],
                               [c for c in SESSION_COLUMNS if c != "opp_assists"])
    with pytest.raises(SchemaContractError) as e:
        assert_columns(df, "sessions", SESSION_COLUMNS)
    msg = str(e.value)
    assert "sessions breaks" in msg and "absent: ['opp_assists'], not declared: []" in msg


def test_zero_incident_kda(spark, tmp_path):
    (tmp_path / "Z.json").write_text(json.dumps(detail("Z", deaths=0)))
    (tmp_path / "Z_timeline.json").write_text(json.dumps({"metadata": {"matchId": "Z"}, "info": {"frames": []}}))
    out = D.flatten(D.read_documents(spark, str(tmp_path), "files"), PLAYER)
    r = out["sessions"].first()
    assert r.deaths == 0 and r.kda == pytest.approx(9.0)
    assert out["ticks"].count() == 0 and out["incidents"].count() == 0
    assert out["sessions"].where(F.col("match_id") == "Z").count() == 1


def test_folders_without_a_commit_are_never_seen(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    a = spark.range(3).withColumnRenamed("id", "k")
    assert store.commit({"t": a}) == 1
    a.write.parquet(str(tmp_path / "s" / "data" / "t" / "commit=c-crashed"))      # data written, then the run ended
    fresh = TableStore(spark, str(tmp_path / "s"))
    assert fresh.version() == 1 and fresh.read("t").count() == 3
    assert fresh.commit({"t": a}, name="crashed") == 2 and fresh.read("t").count() == 6
    store.refresh()
    assert store.version() == 2 and store.read("t").count() == 6


def test_a_commit_of_one_name_counts_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    a = spark.range(3).withColumnRenamed("id", "k")
    assert [store.commit({"t": a, "u": a}, name="batch-7") for _ in range(2)] == [1, 1]
    assert store.read("t").count() == 3
    assert store.commit({"u": a.limit(1)}, replace=("u",)) == 2
    assert store.read("u").count() == 1 and store.read("t").count() == 3
    store.commit({"t": a.limit(0)}, mode="replace")
    assert store.read("t").count() == 0 and store.tables() == ["t", "u"]
    assert TableStore(spark, str(tmp_path / "none")).version() == 0 and TableStore(spark, str(tmp_path / "none")).read("t") is None


def test_an_unreadable_commit_table_is_not_an_empty_store(spark, tmp_path):
    TableStore(spark, str(tmp_path / "s")).commit({"t": spark.range(1)})
    for f in (tmp_path / "s" / "commits").glob("part-*"):
        f.write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        TableStore(spark, str(tmp_path / "s")).version()


TICKS_ROW = "match_id string, timestamp_min int, gold long"


def test_an_append_reads_the_buckets_of_its_keys(spark, tmp_path):
    from playline.plans.tables import BUCKET, absent_rows
    store = TableStore(spark, str(tmp_path / "s"), buckets=16)
    rows = [(f"m{k}", t, 10 * t) for k in range(200) for t in range(3)]
    store.commit({"ticks": spark.createDataFrame(rows, TICKS_ROW)})
    longer = [("m7", t, -1) for t in range(6)]
    fresh = absent_rows({"ticks": spark.createDataFrame(longer, TICKS_ROW)}, store, {"ticks": ("match_id", "timestamp_min")})
    plan = fresh["ticks"]._jdf.queryExecution().executedPlan().toString()
    bucket = spark.createDataFrame([("m7",)], "match_id string").select(store.bucket("match_id")).first()[0]
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan and f"= {bucket})" in plan
    read = [r[0] for r in store.read("ticks", [bucket]).select(F.input_file_name()).distinct().collect()]
    assert read and all(f"/{BUCKET}={bucket}/" in f for f in read)
    scanned = plan[plan.index("FileScan"):].split("ReadSchema:")[1].split("\n")[0]
    assert "gold" not in scanned
    assert sorted(tuple(r) for r in fresh["ticks"].collect()) == [("m7", t, -1) for t in (3, 4, 5)]
    store.commit(fresh)
    assert store.read("ticks").where("match_id = 'm7'").agg({"gold": "sum"}).first()[0] == 0 + 10 + 20 - 3
    assert absent_rows({"ticks": spark.createDataFrame(longer, TICKS_ROW)}, store, {"ticks": ("match_id", "timestamp_min")})["ticks"].count() == 0
    assert TableStore(spark, str(tmp_path / "s"), buckets=99).buckets == 16


def test_a_longer_parse_adds_its_new_ticks(spark, tmp_path):
    """Table by table, the first write wins: the session stays, stored minutes stay, new minutes and incidents are added."""
    raw, store = tmp_path / "raw", TableStore(spark, str(tmp_path / "store"))
    raw.mkdir()
    t = timeline()
    (raw / "M1.json").write_text(json.dumps(detail("M1")))
    short = json.loads(json.dumps(t))
    short["info"]["frames"] = short["info"]["frames"][:3]
    (raw / "M1_timeline.json").write_text(json.dumps(short))
    ingest(spark, str(raw), store, PLAYER, layout="files")
    before = {r.timestamp_min: r.gold for r in store.read("ticks").collect()}
    changed = detail("M1")
    changed["info"]["gameVersion"] = "99.9.1"
    (raw / "M1.json").write_text(json.dumps(changed))
    (raw / "M1_timeline.json").write_text(json.dumps(t))
    ingest(spark, str(raw), store, PLAYER, layout="files")
    after = {r.timestamp_min: r.gold for r in store.read("ticks").collect()}
    assert set(before) < set(after) == {0, 1, 3, 5} and all(after[k] == v for k, v in before.items())
    assert store.read("sessions").count() == 1 and store.read("sessions").first().game_version != "99.9"
    assert sorted(r.death_number for r in store.read("incidents").collect()) == [1, 2, 3]


def test_time_columns_do_not_depend_on_the_session_zone(spark, landed):
    from playline.operators.features import temporal
    zone = spark.conf.get("spark.sql.session.timeZone")
    store = TableStore(spark, tempfile.mkdtemp(prefix="store-", dir="/tmp"))
    ingest(spark, landed, store, PLAYER, layout="files")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert store.read("sessions").schema["game_datetime"].dataType.simpleString() == "timestamp_ntz"
        assert temporal(store.read("sessions")).first().hour_of_day == 12
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    wrong = store.read("sessions").withColumn("kills", F.col("kills").cast("long"))
    store.commit({"sessions": wrong}, replace=("sessions",))
    with pytest.raises(SchemaContractError, match="kills: bigint, declared int"):
        ingest(spark, landed, store, PLAYER, layout="files")


def test_first_document_wins_in_all_tables(spark, tmp_path):
    """Two files carry one session id; the one that sorts first gives every row."""
    late = timeline()
    late["info"]["frames"] = [frame(t * 60_000, snap(9000, 1, 1)) for t in range(9)]
    for name, d, t in (("A", detail("S"), timeline()), ("B", detail("S", deaths=1), late)):
        d["info"]["gameVersion"] = {"A": "16.9.1", "B": "15.1.1"}[name]
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
        (tmp_path / f"{name}_timeline.json").write_text(json.dumps(t))
    store = TableStore(spark, tempfile.mkdtemp(prefix="store-", dir="/tmp"))
    out = ingest(spark, str(tmp_path), store, PLAYER, layout="files")
    assert store.read("sessions").first().game_version == "16.9"
    assert sorted(r.gold for r in store.read("ticks").collect()) == [500, 800, 1200, 1500]
    assert tuple(out["summary"].first()) == (2, 0, 1)


def test_stray_elements_are_skipped(spark, tmp_path):
    d, t = detail("M1"), timeline()
    d["info"]["participants"][1:1] = ["stray", 5, None]
    d["info"]["participants"][-1]["kills"] = 5.0
    t["info"]["frames"][1:1] = ["stray", None, 7]
    t["info"]["frames"][0]["events"] = "none"
    t["info"]["frames"][-1]["events"] = ["stray", None]
    t["info"]["frames"][-2]["participantFrames"]["9"] = "stray"
    (tmp_path / "M1.json").write_text(json.dumps(d))
    (tmp_path / "M1_timeline.json").write_text(json.dumps(t))
    out = D.flatten(D.read_documents(spark, str(tmp_path), "files"), PLAYER)
    assert out["quarantine"].count() == 0 and out["sessions"].first().kills == 5
    assert [r.timestamp_min for r in out["ticks"].orderBy("timestamp_min").collect()] == [0, 1, 3, 5]


def test_a_document_without_participants_is_only_quarantined(spark, tmp_path):
    d = detail("E")
    d["metadata"]["participants"], d["info"]["participants"] = [], []
    (tmp_path / "E.json").write_text(json.dumps(d))
    (tmp_path / "E_timeline.json").write_text(json.dumps(timeline()))
    (tmp_path / "M1.json").write_text(json.dumps(detail("M1")))
    (tmp_path / "M1_timeline.json").write_text(json.dumps(timeline()))
    store = TableStore(spark, tempfile.mkdtemp(prefix="store-", dir="/tmp"))
    ingest(spark, str(tmp_path), store, PLAYER, layout="files")
    assert [(r.doc_key, r.reason) for r in store.read("quarantine").collect()] == [("E", "player not found")]
    assert store.read("sessions").count() == 1
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), store, None, layout="files")


def test_ensure_tables_creates_then_checks(spark, tmp_path):
    from playline.plans.tables import ensure_tables
    from playline.schemas import DECLARED
    store = TableStore(spark, str(tmp_path / "s"))
    assert ensure_tables(store) == 1
    assert store.tables() == ["incidents", "sessions", "ticks"] and store.read("ticks").count() == 0
    assert ensure_tables(store) == 1                      # idempotent: nothing to create
    bad = store.read("sessions").drop("opp_assists")
    store.commit({"sessions": bad}, replace=("sessions",))
    with pytest.raises(SchemaContractError, match="opp_assists"):
        ensure_tables(store)
    assert DECLARED["ticks"].fieldNames()[:2] == ["match_id", "timestamp_min"]


def test_quarantine_reasons_lines_layout(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "detail").mkdir(parents=True)
    (raw / "timeline").mkdir(parents=True)
    no_pid = detail("P1")
    for p in no_pid["info"]["participants"]:
        if p["puuid"] == PLAYER:
            p.pop("participantId")
    no_champ = detail("P2")
    for p in no_champ["info"]["participants"]:
        if p["puuid"] == PLAYER:
            p.pop("championName")
    no_version = detail("P3")
    no_version["info"].pop("gameVersion")
    ok = detail("P4")
    lines = [no_pid, no_champ, no_version, ok]
    (raw / "detail" / "d.json").write_text("\n".join(json.dumps(d) for d in lines) + "\n")
    tls = []
    for k in ("P1", "P2", "P3", "P4"):
        t = timeline()
        t["metadata"]["matchId"] = k
        tls.append(t)
    (raw / "timeline" / "t.json").write_text("\n".join(json.dumps(t) for t in tls) + "\n")
    out = D.flatten(D.read_documents(spark, str(raw), "lines"), PLAYER)
    q = {r.doc_key: r.reason for r in out["quarantine"].collect()}
    assert q == {"P1": "participant id missing", "P2": "missing required field", "P3": "missing required field"}
    assert [r.match_id for r in out["sessions"].collect()] == ["P4"]
    assert out["ticks"].count() == 4 and out["incidents"].count() == 3


def test_every_player_of_a_document(spark, tmp_path):
    """A session for each listed player, under the document's id and the player's."""
    from playline.config import AnalysisConfig
    from playline.plans.publish import publish
    raw = tmp_path / "raw"
    raw.mkdir()
    d = detail("M1")
    d["info"]["participants"].append(participant(9, "ally", 200, "MIDDLE", "Again", True, 9, 9, 9, 9, 9, 9))   # listed twice: the first counts
    d["info"]["participants"].append({"puuid": None, "participantId": 10, "championName": "X", "win": True})     # no id: nobody
    no_pid = participant(0, "late", 100, "TOP", "Hotel", False, 0, 0, 0, 0, 0, 0) | {"participantId": None}
    d["info"]["participants"].append(no_pid)
    (raw / "M1.json").write_text(json.dumps(d))
    (raw / "M1_timeline.json").write_text(json.dumps(timeline()))
    (raw / "M2.json").write_text(json.dumps(detail("M2", player="solo")))
    (raw / "M2_timeline.json").write_text(json.dumps({"metadata": {"matchId": "M2"}, "info": {"frames": []}}))
    store = TableStore(spark, str(tmp_path / "store"))
    ingest(spark, str(raw), store, D.EVERY, layout="files")
    rows = {r.match_id: r for r in store.read("sessions").collect()}
    assert set(rows) == {"M1/ally", "M1/enemy-top", "M1/enemy-mid", f"M1/{PLAYER}", "M2/ally", "M2/enemy-top", "M2/enemy-mid", "M2/solo"}
    assert all(r.match_id.endswith("/" + r.puuid) for r in rows.values()) and rows["M1/ally"].champion_name == "Foxtrot"
    assert rows[f"M1/{PLAYER}"].opp_champion_name == "Echo" and rows["M1/enemy-mid"].opp_champion_name == "Delta"
    ticks = {(r.match_id, r.timestamp_min): r for r in store.read("ticks").collect()}
    assert {t for m, t in ticks if m == f"M1/{PLAYER}"} == {0, 1, 3, 5} and {t for m, t in ticks if m == "M1/enemy-mid"} == {0, 1, 2, 3, 5}
    assert ticks[("M1/enemy-mid", 5)].kills == 2 and ticks[(f"M1/{PLAYER}", 5)].kills == 2
    assert not any(m.startswith("M1/ally") for m, _ in ticks)
    deaths = [(r.match_id, r.death_number) for r in store.read("incidents").collect()]
    assert sorted(deaths) == sorted([(f"M1/{PLAYER}", k) for k in (1, 2, 3)] + [("M1/enemy-mid", 1), ("M1/ally", 1)])
    assert [(r.doc_key, r.reason) for r in store.read("quarantine").collect()] == [("M1", "participant id missing")]
    ingest(spark, str(raw), store, D.EVERY, layout="files")          # a second run adds nothing
    assert store.read("sessions").count() == 8 and store.read("ticks").count() == len(ticks)
    from playline.operators import features as FT
    cfg = AnalysisConfig(season_start="2020-01-01 00:00:00")
    tables = {t: store.read(t) for t in ("sessions", "ticks", "incidents")}
    fm = FT.feature_matrix(tables["sessions"], tables["ticks"], tables["incidents"], cfg)
    labels = tables["sessions"].select("match_id", F.lit(0).alias("cluster_id"))
    pub = publish(spark, tables | {"feature_matrix": fm, "cluster_labels": labels}, str(tmp_path / "pub"), cfg)
    shown = [r.match_id for r in pub.read("sessions").collect()]
    assert shown and all(m.startswith("GAME_") for m in shown) and len(set(shown)) == len(shown)
