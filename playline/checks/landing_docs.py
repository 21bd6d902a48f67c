"""Session documents made from the session tables: input of the ingest keys and of the bench.

Details and timelines are built with the inverse of the flattening rules, so
ingesting them must give the tables back. Every session lands. Every third tick
carries an earlier stale frame; the player is neither first in the list nor
alone; a session with a rival lists a second candidate after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playline.functions.scalars import to_epoch_ms
from playline.operators.sequence import number_rows
from playline.sources.documents import EVENT, KILL_EVENT, PARTICIPANT, PARTICIPANT_FRAME, RIVAL_POSITION

VERSION_SUFFIX = ".123.4567"
STALE_EVERY = 3


def _own(puuid: str = "puuid", seat: str | None = None):
    return F.struct(
        F.col(puuid).alias("puuid"), (F.col(seat) if seat else F.lit(1)).alias("participantId"), F.col("team_id").alias("teamId"),
        F.col("team_position").alias("teamPosition"), F.col("team_position").alias("individualPosition"),
        F.col("lane").alias("lane"), F.col("champion_id").alias("championId"),
        F.col("champion_name").alias("championName"), F.col("win").alias("win"), F.col("kills").alias("kills"),
        F.col("deaths").alias("deaths"), F.col("assists").alias("assists"),
        F.col("cs_total").alias("totalMinionsKilled"), F.lit(0).alias("neutralMinionsKilled"),
        F.col("gold_earned").alias("goldEarned"),
        F.col("damage_dealt_to_champions").alias("totalDamageDealtToChampions"),
        F.col("vision_score").alias("visionScore")).cast(PARTICIPANT)


def detail_documents(sessions: DataFrame) -> DataFrame:
    none = F.lit(None)
    rival = F.when(F.col("opp_champion_name").isNotNull(), F.struct(
        F.concat(F.lit("R"), F.col("puuid")).alias("puuid"), F.lit(2).alias("participantId"),
        (F.lit(300) - F.col("team_id")).alias("teamId"), F.lit("").alias("teamPosition"),
        F.lit("MIDDLE").alias("individualPosition"), none.alias("lane"), none.alias("championId"),
        F.col("opp_champion_name").alias("championName"), (~F.col("win")).alias("win"),
        F.col("opp_kills").alias("kills"), F.col("opp_deaths").alias("deaths"),
        F.col("opp_assists").alias("assists"), F.col("opp_cs_total").alias("totalMinionsKilled"),
        F.lit(0).alias("neutralMinionsKilled"), F.col("opp_gold_earned").alias("goldEarned"),
        none.alias("totalDamageDealtToChampions"), none.alias("visionScore")).cast(PARTICIPANT))
    bystander = F.struct(
        F.lit("bystander").alias("puuid"), F.lit(3).alias("participantId"), F.col("team_id").alias("teamId"),
        F.lit(RIVAL_POSITION).alias("teamPosition"), *[none.alias(n) for n in PARTICIPANT.fieldNames()[4:]]).cast(PARTICIPANT)
    second = F.when(rival.isNotNull(), F.struct(
        F.lit("second").alias("puuid"), F.lit(4).alias("participantId"), rival["teamId"].alias("teamId"),
        F.lit(RIVAL_POSITION).alias("teamPosition"), *[none.alias(n) for n in PARTICIPANT.fieldNames()[4:]]).cast(PARTICIPANT))
    # a column: two places of the document read it
    sessions = sessions.withColumn("_people", F.concat(F.array(bystander), F.array_compact(F.array(rival, second)), F.array(_own())))
    people = F.col("_people")
    doc = F.struct(
        F.struct(F.col("match_id").alias("matchId"),
                 F.transform(people, lambda p: p["puuid"]).alias("participants")).alias("metadata"),
        F.struct(to_epoch_ms("game_datetime").alias("gameCreation"),
                 F.concat(F.col("game_version"), F.lit(VERSION_SUFFIX)).alias("gameVersion"),
                 F.col("game_duration_sec").alias("gameDuration"), F.col("queue_id").alias("queueId"),
                 people.alias("participants")).alias("info"))
    return sessions.select("match_id", F.to_json(doc).alias("value"))


SHARES = (1, 2, 10)     # players of successive documents


def shared_seats(sessions: DataFrame) -> DataFrame:
    """(match_id, doc, pid): sessions in the order of their ids sit in documents of 1, 2 and 10 players."""
    n, at = (F.col("_n") - 1) % sum(SHARES), 0
    part, pid = F.lit(None), F.lit(None)
    for k, size in enumerate(SHARES):
        inside = (n >= at) & (n < at + size)
        part, pid = F.when(inside, k).otherwise(part), F.when(inside, n - at + 1).otherwise(pid)
        at += size
    doc = F.concat(F.lit("D"), F.floor((F.col("_n") - 1) / sum(SHARES)).cast("string"), F.lit("-"), part.cast("string"))
    return number_rows(sessions.select("match_id"), [], ["match_id"], out="_n").select("match_id", doc.alias("doc"), pid.cast("int").alias("pid"))


def write_shared(tables: dict[str, DataFrame], path: str, tick_ms: int) -> str:
    """A landing whose documents list 1, 2 or 10 players; session ids serve as player ids,
    and a document has the time, version, length and queue of its first player's session."""
    seats = shared_seats(tables["sessions"]).checkpoint()
    row = F.struct("pid", _own("match_id", "pid").alias("own"), to_epoch_ms("game_datetime").alias("created"),
                   F.concat(F.col("game_version"), F.lit(VERSION_SUFFIX)).alias("version"),
                   F.col("game_duration_sec").alias("duration"), F.col("queue_id").alias("queue"))
    docs = tables["sessions"].join(seats, "match_id").groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.col("rows")[0]
    doc = F.struct(F.struct(F.col("doc").alias("matchId")).alias("metadata"),
                   F.struct(first.created.alias("gameCreation"), first.version.alias("gameVersion"), first.duration.alias("gameDuration"),
                            first.queue.alias("queueId"), F.transform("rows", lambda r: r.own).alias("participants")).alias("info"))
    write_documents(docs.select(F.to_json(doc).alias("value")), f"{path}/detail")
    write_documents(timeline_documents(tables["sessions"], tables["ticks"], tables["incidents"], tick_ms, seats), f"{path}/timeline")
    return path


def timeline_documents(sessions: DataFrame, ticks: DataFrame, incidents: DataFrame, tick_ms: int, seats: DataFrame | None = None) -> DataFrame:
    """Frames per session: one per tick row (snapshot + kill events for the
    kill-count delta), a stale earlier frame every third tick, and
    snapshot-less frames for ticks that only hold incidents. With ``seats``
    the frames of all players of a document are in one timeline.

    Ticks and incidents are shuffled once each, by session; frames are made inside its row."""
    if seats is None:
        at, other = sessions.groupBy("match_id").agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumn("pid", F.lit(1)), 2
    else:
        at, other = seats, 0
    t = ticks.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(
        "timestamp_min", "kills", "gold", "cs", "xp", "position_x", "position_y"))).alias("t"))
    d = incidents.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("death_number", "timestamp_ms", "timestamp_min"))).alias("d"))
    rows = at.join(t, "match_id", "left").join(d, "match_id", "left")
    # plain columns from here on: what a lambda reads of its row is not worked out again for every element
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("t", "d")})
    key, events, snaps = F.col("pid").cast("string"), T.ArrayType(EVENT), T.MapType(T.StringType(), PARTICIPANT_FRAME)
    frame = "struct<timestamp:bigint,participantFrames:{},events:{}>".format(snaps.simpleString(), events.simpleString())

    def snapshot(x):
        return F.struct(x.gold.alias("totalGold"), x.cs.alias("minionsKilled"), F.lit(0).alias("jungleMinionsKilled"), x.xp.alias("xp"),
                        F.when(x.position_x.isNotNull(), F.struct(x.position_x.alias("x"), x.position_y.alias("y"))).alias("position"))

    def kill(killer, victim, at_ms):
        return F.named_struct(F.lit("type"), F.lit(KILL_EVENT), F.lit("killerId"), killer, F.lit("victimId"), victim, F.lit("timestamp"), at_ms)

    def deaths(tick):
        return F.transform(F.filter("d", lambda e: e.timestamp_min.eqNullSafe(tick)), lambda e: kill(F.lit(other), F.col("pid"), e.timestamp_ms))

    def begin(tick):
        return tick.cast("long") * F.lit(tick_ms)

    def real(x, i):
        ts = begin(x.timestamp_min) + F.lit(1000)
        n = F.greatest(F.coalesce(x.kills - F.coalesce(F.get(F.col("t"), i - 1)["kills"], F.lit(0)), F.lit(0)), F.lit(0))
        kills = F.transform(F.array_repeat(F.lit(0), n), lambda _: kill(F.col("pid"), F.lit(other), ts))
        own = F.when(x.timestamp_min.isNotNull(), deaths(x.timestamp_min))
        return F.struct(ts.alias("timestamp"), F.create_map(key, snapshot(x)).alias("participantFrames"),
                        F.concat(kills, F.coalesce(own, F.array().cast(events))).alias("events")).cast(frame)

    def bare(tick):
        return F.struct((begin(tick) + F.lit(1000)).alias("timestamp"), F.create_map().cast(snaps).alias("participantFrames"),
                        deaths(tick).alias("events")).cast(frame)

    def stale(x):
        before = F.struct((x.gold - 7).alias("totalGold"), F.lit(0).alias("minionsKilled"), F.lit(0).alias("jungleMinionsKilled"),
                          F.lit(0).alias("xp"), F.lit(None).cast("struct<x:int,y:int>").alias("position"))
        return F.struct(begin(x.timestamp_min).alias("timestamp"), F.create_map(key, before).alias("participantFrames"),
                        F.array().cast(events).alias("events")).cast(frame)

    rows = rows.withColumn("_held", F.transform("t", lambda x: x.timestamp_min))
    alone = F.filter(F.array_distinct(F.transform("d", lambda e: e.timestamp_min)),
                     lambda k: ~F.coalesce(F.array_contains("_held", k), F.lit(False)))
    frames = F.concat(F.transform("t", real), F.transform(alone, bare),
                      F.transform(F.filter("t", lambda x: x.timestamp_min % STALE_EVERY == 0), stale))
    if seats is None:
        docs = rows.select(F.col("match_id").alias("doc"), F.flatten(F.array_repeat(frames, F.col("copies"))).alias("frames"))
    else:
        docs = rows.select("doc", frames.alias("frames")).groupBy("doc").agg(F.flatten(F.collect_list("frames")).alias("frames"))
    ordered = F.array_sort("frames", lambda a, b: F.when(a.timestamp < b.timestamp, -1).when(a.timestamp > b.timestamp, 1).otherwise(0))
    # a session without ticks and incidents still lands a timeline, with no frames
    doc = F.struct(F.struct(F.col("doc").alias("matchId")).alias("metadata"), F.struct(ordered.alias("frames")).alias("info"))
    return docs.select(F.col("doc").alias("match_id"), F.to_json(doc).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON Lines, compressed: documents repeat their field names."""
    docs.select("value").write.mode("error").option("compression", "lz4").text(path)


def write_landing(tables: dict[str, DataFrame], path: str, tick_ms: int, part: str = "",
                  details: bool = True, timeline_keys: DataFrame | None = None) -> str:
    """Write JSON Lines documents of every session under ``path``/detail[/part] and
    ``path``/timeline[/part]; ``details=False`` and ``timeline_keys`` (match_id frame)
    let a landing arrive over several runs."""
    suffix = f"/{part}" if part else ""
    if details:
        write_documents(detail_documents(tables["sessions"]), f"{path}/detail{suffix}")
    t = timeline_documents(tables["sessions"], tables["ticks"], tables["incidents"], tick_ms)
    if timeline_keys is not None:
        t = t.join(timeline_keys, "match_id", "left_semi")
    write_documents(t, f"{path}/timeline{suffix}")
    return path


def _renamed(match_id: str, text, tag: str):
    """The same document under another session id (id + tag)."""
    return F.replace(text, F.concat(F.lit('"matchId":"'), F.col(match_id), F.lit('"')),
                     F.concat(F.lit('"matchId":"'), F.col(match_id), F.lit(f'{tag}"')))


# Added to a landing, each once for every session: tag -> (edit of the detail, edit of the timeline, reason).
# None: that document does not land.
DEFECTS = {
    "#no-timeline": (lambda d: d, None, "timeline missing"),
    "#orphan": (None, lambda t: t, None),
    "#absent": (lambda d: F.regexp_replace(d, r'"puuid":"([0-9]+)"', '"puuid":"not-$1"'), lambda t: t, "player not found"),
    "#no-version": (lambda d: F.regexp_replace(d, r'"gameVersion":"[^"]*",', ""), lambda t: t, "missing required field"),
    "#no-id": (lambda d: F.replace(d, F.lit('"participantId":1,'), F.lit("")), lambda t: t, "participant id missing"),
    "#no-list": (lambda d: F.regexp_replace(d, r'"participants":\[\{.*\}\]', '"participants":null'), lambda t: t,
                 "participants not a list"),
    "#broken": (lambda d: F.concat(F.lit("{"), F.substring(d, 1, 60)), None, "malformed document"),
    "#bad-frames": (lambda d: d, lambda t: F.regexp_replace(t, r'"frames":\[.*\]', '"frames":{"a":1}'), "malformed timeline"),
}


def write_defects(path: str) -> str:
    """Add the documents of DEFECTS to a landing: its own documents are read once and edited."""
    spark = SparkSession.active()
    for at, kind in enumerate(("detail", "timeline")):
        edits = [(tag, edit[at]) for tag, edit in DEFECTS.items() if edit[at] is not None]
        landed = spark.read.text(f"{path}/{kind}").select(
            "value", F.regexp_extract("value", r'^\{"metadata":\{"matchId":"([^"]*)"', 1).alias("match_id"))
        write_documents(landed.select(F.explode(F.array(*[edit(_renamed("match_id", F.col("value"), tag)) for tag, edit in edits]))
                                      .alias("value")), f"{path}/{kind}/defects")
    return path


def write_strays(tables: dict[str, DataFrame], path: str, tick_ms: int) -> str:
    """A landing of every session whose documents carry stray elements: a text
    among participants, frames, events and snapshots, and counters like 12.0."""
    d = detail_documents(tables["sessions"]).select(F.regexp_replace(F.replace(
        F.col("value"), F.lit('"participants":[{'), F.lit('"participants":["stray",7,{')),
        r'"(kills|deaths|goldEarned|gameDuration)":([0-9]+)', '"$1":$2.0').alias("value"))
    t = timeline_documents(tables["sessions"], tables["ticks"], tables["incidents"], tick_ms).select(F.regexp_replace(
        F.replace(F.replace(F.col("value"), F.lit('"frames":['), F.lit('"frames":["stray",5,')),
                  F.lit('"events":['), F.lit('"events":["stray",null,')),
        r'"(totalGold|xp|timestamp)":([0-9]+)', '"$1":$2.0').alias("value"))
    t = t.select(F.replace(F.replace(F.col("value"), F.lit(',]'), F.lit(']')), F.lit('"participantFrames":{'),
                           F.lit('"participantFrames":{"9":"stray",')).alias("value"))
    t = t.select(F.replace(F.col("value"), F.lit(",}"), F.lit("}")).alias("value"))
    write_documents(d, f"{path}/detail")
    write_documents(t, f"{path}/timeline")
    return path


def write_null_counters(tables: dict[str, DataFrame], path: str, tick_ms: int) -> str:
    """A landing whose documents, by their player's number, keep their kills, lack them or have them as null."""
    kind = F.split("match_id", "-")[0].cast("long") % 3
    text = (F.when(kind == 1, F.regexp_replace("value", '"kills":[0-9]+,', ""))
            .when(kind == 2, F.regexp_replace("value", '"kills":[0-9]+,', '"kills":null,')).otherwise(F.col("value")))
    write_documents(detail_documents(tables["sessions"]).select(text.alias("value")), f"{path}/detail")
    return write_landing(tables, path, tick_ms, details=False)


SHARDS = 256


def write_files(tables: dict[str, DataFrame], path: str, tick_ms: int) -> str:
    """The ``files`` layout: one document per file, named after its session, in SHARDS sub-folders
    (a folder is listed by one task).

    Tasks write the files themselves (Spark's writers name no files); a task that
    runs twice writes the same bytes again."""
    def write_each(rows):
        from pyarrow import fs
        where, root = fs.FileSystem.from_uri(path)
        made = set()
        for shard, stem, value in rows:
            if shard not in made:
                where.create_dir(f"{root}/{shard}", recursive=True)
                made.add(shard)
            with where.open_output_stream(f"{root}/{shard}/{stem}.json") as out:
                out.write(value.encode())
    for kind, docs in (("", detail_documents(tables["sessions"])),
                       ("_timeline", timeline_documents(tables["sessions"], tables["ticks"], tables["incidents"], tick_ms))):
        docs.select(F.pmod(F.xxhash64("match_id"), F.lit(SHARDS)), F.concat("match_id", F.lit(kind)), "value").foreachPartition(write_each)
    return path


def write_duplicates(tables: dict[str, DataFrame], path: str, tick_ms: int) -> str:
    """A second pair of documents for every session, later in file order and
    smaller in every counter: it must lose."""
    write_landing(tables, path, tick_ms, part="a")
    low = tables["sessions"].withColumns({c: F.lit(0) for c in ("kills", "assists", "cs_total")}).withColumn(
        "game_version", F.lit("0.0"))
    flat = tables["ticks"].withColumn("gold", F.lit(-1).cast("long")).withColumn("timestamp_min", F.col("timestamp_min") + 30)
    return write_landing(tables | {"sessions": low, "ticks": flat}, path, tick_ms, part="b")
