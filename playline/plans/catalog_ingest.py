"""Ingest, table-maintenance and landing keys of the query registry.

Each query lands documents made from the driver tables into a fresh folder
under the shared checkpoint root, then runs the operator on what it reads back,
so the oracle is the adapter's own tables. Every session lands; defective
documents are extra ones (checks/landing_docs.py). A session id starts with its
player's id, which gives the tracked player of each document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from playline.checks import landing_docs as LD
from playline.config import ADAPTER as CFG
from playline.plans.catalog import FEAT, R, T2, T3, register
from playline.plans.increment import refresh_features
from playline.plans.ingest import ingest
from playline.plans.tables import TableStore
from playline.schemas import DECLARED, PRIMARY_KEYS, contract_violations, schema_diff
from playline.session import shared_path
from playline.sources import adapter, documents as D, landing as L

MS = "epoch_ms(epoch_us(game_datetime) // 1000)"
SESSIONS = f"SELECT * REPLACE ({MS} AS game_datetime) FROM sessions"


def player():
    return F.split("metadata.matchId", "-")[0]


def _tables(spark, sf):
    return dict(zip(("sessions", "ticks", "incidents"), T3(spark, sf)))


def land(spark, sf, write=LD.write_landing, defects=False):
    path = write(_tables(spark, sf), shared_path(spark, "landing"), CFG.tick_ms)
    return LD.write_defects(path) if defects else path


def flat(spark, sf, **kw):
    return D.flatten(D.read_documents(spark, land(spark, sf, **kw), "lines"), player(), CFG.tick_ms)


# ---------------------------------------------------------------- S1-S4, P2-P5, W1-W3, N1-N8
register("ingest_sessions", R(SESSIONS, "kda", "cs_per_min"))(lambda s, sf: flat(s, sf)["sessions"])
register("ingest_ticks", R("SELECT * FROM ticks"))(lambda s, sf: flat(s, sf)["ticks"])
register("ingest_incidents", R("SELECT * FROM incidents"))(lambda s, sf: flat(s, sf)["incidents"])
register("ingest_bad_elements", R(SESSIONS, "kda", "cs_per_min"))(
    lambda s, sf: flat(s, sf, write=LD.write_strays)["sessions"])
register("ingest_bad_elements_ticks", R("SELECT * FROM ticks"))(
    lambda s, sf: flat(s, sf, write=LD.write_strays)["ticks"])
register("ingest_bad_elements_incidents", R("SELECT * FROM incidents"))(
    lambda s, sf: flat(s, sf, write=LD.write_strays)["incidents"])
register("ingest_duplicates", R(SESSIONS, "kda", "cs_per_min"))(
    lambda s, sf: flat(s, sf, write=LD.write_duplicates)["sessions"])
register("ingest_duplicates_ticks", R("SELECT * FROM ticks"))(
    lambda s, sf: flat(s, sf, write=LD.write_duplicates)["ticks"])


@register("ingest_files", R(SESSIONS, "kda", "cs_per_min"))
def _files(s, sf):
    """The landing of the analysed application: the player's documents, one object per file."""
    path = LD.write_files(_tables(s, sf), shared_path(s, "landing"), CFG.tick_ms)
    return D.flatten(D.read_documents(s, path, "files"), player(), CFG.tick_ms)["sessions"]


_REASONS = " UNION ALL ".join(
    f"SELECT {'NULL' if tag == '#broken' else f"match_id || '{tag}'"} AS doc_key, '{reason}' AS reason FROM sessions"
    for tag, reason in (("#no-timeline", "timeline missing"), ("#absent", "player not found"),
                        ("#no-version", "missing required field"), ("#no-id", "participant id missing"),
                        ("#no-list", "participants not a list"), ("#broken", "malformed document"),
                        ("#bad-frames", "malformed timeline")))
register("ingest_quarantine", R(_REASONS))(
    lambda s, sf: flat(s, sf, defects=True)["quarantine"].select("doc_key", "reason"))
register("ingest_orphans", R("SELECT match_id || '#orphan' AS doc_key FROM sessions"))(
    lambda s, sf: flat(s, sf, defects=True)["orphans"].select("doc_key"))
register("own_participant", R("SELECT match_id, puuid, champion_name, win FROM sessions"))(
    lambda s, sf: flat(s, sf)["usable"].select("match_id", F.col("own.puuid").alias("puuid"),
                                               F.col("own.championName").alias("champion_name"), F.col("own.win").alias("win")))


@register("rival_of", R(
    "SELECT match_id, CASE WHEN CAST(puuid AS BIGINT) % 3 = 0 THEN NULL ELSE opp_champion_name END AS rival, "
    "CASE WHEN CAST(puuid AS BIGINT) % 3 = 0 OR opp_champion_name IS NULL THEN 0 ELSE 2 END AS candidates FROM sessions"))
def _rival(s, sf):
    """A third of the sessions land without a rival (0 candidates), the others with two: the first counts."""
    t = _tables(s, sf)
    gone = F.col("puuid").cast("long") % 3 == 0
    t["sessions"] = t["sessions"].withColumn("opp_champion_name", F.when(~gone, F.col("opp_champion_name")))
    path = LD.write_landing(t, shared_path(s, "landing"), CFG.tick_ms)
    rows = D.pair_documents(D.read_documents(s, path, "lines"), player())["usable"]
    rivals = D.parsed_each(F.col("people"), D.PARTICIPANT)
    people = D.read_documents(s, path, "lines").where("kind = 'detail'").select(
        F.col("metadata.matchId").alias("match_id"), F.col("info.participants").alias("people"))
    own_team = F.element_at(rivals, -1)["teamId"]
    n = F.size(F.filter(rivals, lambda p: (p.teamId != own_team) & (
        F.coalesce(p.individualPosition, p.teamPosition) == D.RIVAL_POSITION)))
    return (rows.select("match_id", F.col("_rival.championName").alias("rival"))
            .join(people.select("match_id", n.alias("candidates")), "match_id"))


# ---------------------------------------------------------------- P2, every player of a document
_SEATED = """n AS (SELECT *, row_number() OVER (ORDER BY match_id) - 1 AS n FROM sessions),
seated AS (SELECT *, 'D' || n // 13 || '-' || CASE WHEN n % 13 = 0 THEN 0 WHEN n % 13 < 3 THEN 1 ELSE 2 END AS doc,
  CASE WHEN n % 13 = 0 THEN 1 WHEN n % 13 < 3 THEN n % 13 ELSE n % 13 - 2 END AS pid FROM n),
facing AS (SELECT a.match_id AS own, b.* FROM seated a JOIN seated b ON b.doc = a.doc AND b.team_id <> a.team_id
  AND b.team_position = 'MIDDLE' QUALIFY row_number() OVER (PARTITION BY a.match_id ORDER BY b.pid) = 1)"""
_ALL = f"""SELECT s.doc || '/' || s.match_id AS match_id, s.match_id AS puuid, {MS.replace('game_datetime', 'h.game_datetime')} AS game_datetime,
  h.game_version, h.queue_id, h.game_duration_sec, s.champion_id, s.champion_name, s.team_id, s.team_position, s.lane, s.win,
  s.kills, s.deaths, s.assists, s.kda, s.cs_total,
  CASE WHEN h.game_duration_sec > 0 THEN s.cs_total / (h.game_duration_sec / 60.0) ELSE 0 END AS cs_per_min,
  s.gold_earned, s.damage_dealt_to_champions, s.vision_score, r.champion_name AS opp_champion_name, r.cs_total AS opp_cs_total,
  r.gold_earned AS opp_gold_earned, r.kills AS opp_kills, r.deaths AS opp_deaths, r.assists AS opp_assists
FROM seated s JOIN seated h ON h.doc = s.doc AND h.pid = 1 LEFT JOIN facing r ON r.own = s.match_id"""


def _everyone(s, sf):
    path = LD.write_shared(_tables(s, sf), shared_path(s, "landing"), CFG.tick_ms)
    return D.flatten(D.read_documents(s, path, "lines"), D.EVERY, CFG.tick_ms)


register("ingest_all_players", R(_ALL, "kda", "cs_per_min", extra=_SEATED))(lambda s, sf: _everyone(s, sf)["sessions"])
for _table in ("ticks", "incidents"):
    register(f"ingest_all_players_{_table}", R(
        f"SELECT t.* REPLACE (s.doc || '/' || t.match_id AS match_id) FROM {_table} t JOIN seated s USING (match_id)", extra=_SEATED))(
        lambda s, sf, table=_table: _everyone(s, sf)[table])


# ---------------------------------------------------------------- S5, K1, K2, K8
@register("ingest_summary", R(
    "SELECT count(*) AS processed, 7 * count(*) AS skipped, count(*) AS total_rows FROM sessions"))
def _summary(s, sf):
    store = TableStore(s, shared_path(s, "store"))
    return ingest(s, land(s, sf, defects=True), store, player(), CFG.tick_ms)["summary"]


@register("stored_quarantine", R(_REASONS))
def _stored(s, sf):
    store = TableStore(s, shared_path(s, "store"))
    ingest(s, land(s, sf, defects=True), store, player(), CFG.tick_ms)
    return store.read("quarantine").select("doc_key", "reason")


@register("upsert_ignore", R("SELECT * FROM ticks"))
def _twice(s, sf):
    """A landing, then one whose documents all differ for stored sessions: the first write wins."""
    store = TableStore(s, shared_path(s, "store"))
    ingest(s, land(s, sf), store, player(), CFG.tick_ms)
    t = _tables(s, sf)
    later = t | {"ticks": t["ticks"].withColumn("gold", F.lit(-5).cast("long"))}
    ingest(s, LD.write_landing(later, shared_path(s, "landing"), CFG.tick_ms), store, player(), CFG.tick_ms)
    return store.read("ticks")


_EARLY = 8


@register("upsert_longer_timeline", R(
    f"SELECT * REPLACE (CASE WHEN timestamp_min < {_EARLY} THEN gold ELSE -5 END AS gold) FROM ticks"))
def _longer(s, sf):
    """Sessions landed with their early minutes, then whole with other values: stored minutes stay, new ones are added."""
    store, t = TableStore(s, shared_path(s, "store")), _tables(s, sf)
    early = t | {n: t[n].where(F.col("timestamp_min") < _EARLY) for n in ("ticks", "incidents")}
    ingest(s, LD.write_landing(early, shared_path(s, "landing"), CFG.tick_ms), store, player(), CFG.tick_ms)
    later = t | {"ticks": t["ticks"].withColumn("gold", F.lit(-5).cast("long"))}
    ingest(s, LD.write_landing(later, shared_path(s, "landing"), CFG.tick_ms), store, player(), CFG.tick_ms)
    return store.read("ticks")


@register("features_increment", R(f"SELECT * REPLACE ({MS} AS game_datetime) FROM fm", "tilt_index", "gold_delta",
                                  "tilt_spiral_ratio", "avg_cs_sacrifice", "roam_impact_rate", extra=FEAT))
def _features_increment(s, sf):
    """K8: half of the sessions land with their early minutes, then all with all minutes;
    after each landing the matrix advances by the delta rule."""
    store, t = TableStore(s, shared_path(s, "store")), _tables(s, sf)
    half = t | {"sessions": t["sessions"].where(F.crc32("match_id") % 2 == 0)}
    early = half | {n: t[n].where(F.col("timestamp_min") < _EARLY).join(half["sessions"], "match_id", "left_semi")
                    for n in ("ticks", "incidents")}
    for landing in (early, t):
        ingest(s, LD.write_landing(landing, shared_path(s, "landing"), CFG.tick_ms), store, player(), CFG.tick_ms)
        out = refresh_features(store, CFG)
    return out


@register("refresh_full", R("SELECT * FROM incidents"))
def _full(s, sf):
    """Incremental load followed by a full rebuild from raw gives the same table."""
    store, path = TableStore(s, shared_path(s, "store")), land(s, sf)
    ingest(s, path, store, player(), CFG.tick_ms, mode="incremental")
    ingest(s, path, store, player(), CFG.tick_ms, mode="full")
    return store.read("incidents")


# ---------------------------------------------------------------- K6 -------
@register("schema_diff", R(
    "SELECT * FROM (VALUES ('sessions', 'absent', 'opp_assists'), ('sessions', 'not declared', 'mood'), "
    "('ticks', 'absent', 'xp'), ('incidents', 'not declared', 'place')) v(table_name, problem, column_name) "
    "WHERE (SELECT count(*) FROM sessions) > 0"))
def _diff(s, sf):
    """Tables read back from a store whose columns drifted from their contract."""
    t = _tables(s, sf)
    drifted = {"sessions": t["sessions"].drop("opp_assists").withColumn("mood", F.lit(1)), "ticks": t["ticks"].drop("xp"),
               "incidents": t["incidents"].withColumn("place", F.lit("x"))}
    store = TableStore(s, shared_path(s, "store"))
    store.commit(drifted)
    rows = [(n, problem, c) for n in drifted
            for problem, cols in zip(("absent", "not declared"), schema_diff(store.read(n).columns, DECLARED[n].fieldNames()))
            for c in cols]
    return s.createDataFrame(rows, "table_name string, problem string, column_name string")


# ---------------------------------------------------------------- K7 -------
def _contract_sql() -> str:
    parts = []
    for table, schema in (("sessions", DECLARED["sessions"]), ("ticks", DECLARED["ticks"]),
                          ("incidents", DECLARED["incidents"])):
        for f in schema.fields:
            if not f.nullable:
                parts.append(f"SELECT '{table}' AS table_name, 'not_null:{f.name}' AS rule, "
                             f"CAST(count(*) FILTER (WHERE {f.name} IS NULL) AS BIGINT) AS violations FROM {table}")
        keys = ", ".join(PRIMARY_KEYS[table])
        parts.append(f"SELECT '{table}', 'pk:{','.join(PRIMARY_KEYS[table])}', "
                     f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {table} "
                     f"GROUP BY {keys} HAVING count(*) > 1) d")
    return " UNION ALL ".join(parts)


@register("contract_violations_found", R(
    "SELECT rule, CAST(v AS BIGINT) AS violations FROM (SELECT 'not_null:gold' AS rule, count(*) FILTER (WHERE xp % 2 = 0) AS v "
    "FROM ticks UNION ALL SELECT 'pk:match_id,timestamp_min', count(*) FILTER (WHERE cs % 3 = 0) FROM ticks "
    "UNION ALL SELECT 'not_null:' || unnest(['match_id', 'timestamp_min', 'cs', 'xp', 'kills']), 0)"))
def _found(s, sf):
    """Ticks with values blanked out and rows repeated."""
    t = T3(s, sf)[1]
    blank = F.when(F.col("xp") % 2 != 0, F.col("gold")).alias("gold")
    bad = t.select(*[blank if c == "gold" else F.col(c) for c in t.columns])
    again = t.where("cs % 3 = 0").select(*[F.lit(1).cast("long").alias("gold") if c == "gold" else F.col(c) for c in t.columns])
    return contract_violations(bad.unionByName(again), DECLARED["ticks"], PRIMARY_KEYS["ticks"])


@register("contract_violations", R(_contract_sql()))
def _contract(s, sf):
    out = None
    for name, df in zip(("sessions", "ticks", "incidents"), T3(s, sf)):
        schema = DECLARED[name]
        r = contract_violations(df, schema, PRIMARY_KEYS[name]).select(F.lit(name).alias("table_name"), "*")
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- S6-S9 ----
def _inventory(s, sf):
    """Landed documents (match_id, kind) of a landing with defects, read back."""
    return D.read_documents(s, land(s, sf, defects=True), "lines").where("doc_key IS NOT NULL").select(
        F.col("doc_key").alias("match_id"), "kind")


def _asked(s, sf, *tags):
    """Keys to collect: every session, and each of them under the given tags."""
    m = T2(s, sf)[0].select("match_id")
    return m.select(F.explode(F.array(F.col("match_id"), *[F.concat(F.col("match_id"), F.lit(t)) for t in tags])).alias("match_id"))


register("new_keys", R(
    "SELECT match_id || tag AS match_id FROM sessions, (VALUES ('#orphan'), ('#never')) v(tag)"))(
    lambda s, sf: L.new_keys(_asked(s, sf, "#orphan", "#never", "#absent"),
                             _inventory(s, sf).where(F.col("kind") == "detail")))

register("first_n_distinct", R(
    "SELECT match_id, min(event_id) AS pos FROM ev2 GROUP BY match_id ORDER BY pos, match_id LIMIT 100"))(
    lambda s, sf: L.first_n_distinct(
        adapter.event_frame(adapter.load_events(s, sf)).select("match_id", F.col("event_id").alias("pos")),
        "match_id", "pos", 100))

register("candidate_filter", R(
    "SELECT match_id, queue_id, game_datetime FROM sessions WHERE queue_id = 420 "
    "AND game_datetime >= TIMESTAMP '2024-01-06 00:00:00' AND game_datetime <= TIMESTAMP '2024-01-25 00:00:00'"))(
    lambda s, sf: L.candidate_filter(T2(s, sf)[0].select("match_id", "queue_id", "game_datetime"), 420,
                                     "2024-01-06 00:00:00", "2024-01-25 00:00:00"))


@register("landing_status", R(
    "SELECT match_id || tag AS match_id, CASE WHEN tag = '' THEN (CASE WHEN CAST(split_part(match_id, '-', 1) AS BIGINT) % 2 = 0 "
    "THEN 'skipped' ELSE 'saved' END) ELSE status END AS status FROM sessions, (VALUES ('', ''), "
    "('#no-timeline', 'timeline missing'), ('#orphan', 'detail missing'), ('#never', 'missing')) v(tag, status)"))
def _status(s, sf):
    inv = _inventory(s, sf)
    before = inv.where(F.split("match_id", "-")[0].cast("long") % 2 == 0)
    keys = _asked(s, sf, "#no-timeline", "#orphan", "#never")
    return L.landing_status(keys, before, inv)


# ---------------------------------------------------------------- ST1 ------
@register("ingest_increment", R("SELECT * FROM ticks"))
def _increment(s, sf):
    """Two landings processed by two availableNow runs of the stream: half of
    the timelines arrive only in the second landing, after their details."""
    from playline.streaming.ingest_stream import ingest_stream
    tables = _tables(s, sf)
    raw, store = shared_path(s, "landing"), TableStore(s, shared_path(s, "store"))
    ckpt = shared_path(s, "stream-ckpt")
    keys = tables["sessions"].select("match_id")
    even = keys.where(F.split("match_id", "-")[0].cast("long") % 2 == 0)
    odd = keys.join(even, "match_id", "left_anti")
    LD.write_landing(tables, raw, CFG.tick_ms, part="p1", timeline_keys=even)
    ingest_stream(s, raw, store, ckpt, player(), CFG.tick_ms)
    LD.write_landing(tables, raw, CFG.tick_ms, part="p2", details=False, timeline_keys=odd)
    ingest_stream(s, raw, store, ckpt, player(), CFG.tick_ms)
    return store.read("ticks")
