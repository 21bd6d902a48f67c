"""Nested session documents: schemas, reader, flattening.

A session lands as two JSON documents: a *detail* document (participants and
their end-of-session stats) and a *timeline* document (frames with
per-participant snapshots and events). Two landing layouts are read:

* ``files`` - one pretty-printed object per file, ``<key>.json`` and
  ``<key>_timeline.json`` (the analysed application's layout; multi-line JSON,
  key from the file stem);
* ``lines`` - JSON Lines under ``detail/`` and ``timeline/`` sub-folders, key
  from ``metadata.matchId`` (the layout a bulk landing job writes).

Nested elements are tolerated one by one: participants, frames, events and
snapshots are read as text and parsed each on its own, so a stray element is
skipped and the session stays; numbers may come as ``12`` or ``12.0``.

Flattening never explodes a document into rows before it has to: the player's
participant, rival, running kill count, last-frame-per-tick rule and incident
numbering are all array higher-order functions evaluated inside the document
row. Documents meet in the pairing join; of several documents with one session
id the first to arrive wins, for all three tables.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from playline.functions.scalars import first_present, from_epoch_ms, major_minor, per_minute
from playline.schemas import INCIDENTS_SCHEMA, TICKS_SCHEMA, conform, sessions_schema

# Document vocabulary.
KILL_EVENT = "CHAMPION_KILL"
RIVAL_POSITION = "MIDDLE"
COUNTERS = ("kills", "deaths", "assists", "totalMinionsKilled", "neutralMinionsKilled", "goldEarned",
            "totalDamageDealtToChampions", "visionScore")
#: In place of a player's id: a session for every player that a document lists.
EVERY = "*"
SEAT = "/"          # between document id and player id in the session ids that EVERY gives

_I, _L, _S, _B = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()

PARTICIPANT = T.StructType([T.StructField(n, t) for n, t in [
    ("puuid", _S), ("participantId", _I), ("teamId", _I), ("teamPosition", _S), ("individualPosition", _S),
    ("lane", _S), ("championId", _I), ("championName", _S), ("win", _B), ("kills", _I), ("deaths", _I),
    ("assists", _I), ("totalMinionsKilled", _I), ("neutralMinionsKilled", _I), ("goldEarned", _L),
    ("totalDamageDealtToChampions", _L), ("visionScore", _I)]])
POSITION = T.StructType([T.StructField("x", _I), T.StructField("y", _I)])
PARTICIPANT_FRAME = T.StructType([T.StructField(n, t) for n, t in [
    ("totalGold", _L), ("minionsKilled", _I), ("jungleMinionsKilled", _I), ("xp", _I), ("position", POSITION)]])
EVENT = T.StructType([T.StructField(n, t) for n, t in [
    ("type", _S), ("killerId", _I), ("victimId", _I), ("timestamp", _L)]])
FRAME = T.StructType([
    T.StructField("timestamp", _L),
    T.StructField("participantFrames", T.MapType(_S, PARTICIPANT_FRAME)),   # keyed by participant id text
    T.StructField("events", T.ArrayType(EVENT))])
# As read: elements as text, a frame's parts as text.
TEXTS = T.ArrayType(_S)
RAW_FRAME = T.StructType([T.StructField("timestamp", T.DoubleType()),
                          T.StructField("participantFrames", T.MapType(_S, _S)), T.StructField("events", TEXTS)])
_D = T.DoubleType()
DOC_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("matchId", _S)])),
    T.StructField("info", T.StructType([
        T.StructField("gameCreation", _D), T.StructField("gameVersion", _S), T.StructField("gameDuration", _D),
        T.StructField("queueId", _D), T.StructField("participants", TEXTS), T.StructField("frames", TEXTS)])),
    T.StructField("_corrupt_record", _S)])


def _loose(t: T.DataType) -> T.DataType:
    """The same type with every whole number read as a double."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in t.fields])
    return T.DoubleType() if isinstance(t, (T.IntegerType, T.LongType)) else t


def parsed(text: Column, schema: T.StructType) -> Column:
    """One nested object; anything that is not an object is NULL."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _loose(schema)).cast(schema))


# A frame with its snapshots and events as objects, whole numbers as doubles.
WHOLE_FRAME = T.StructType([
    T.StructField("timestamp", _D), T.StructField("participantFrames", T.MapType(_S, _loose(PARTICIPANT_FRAME))),
    T.StructField("events", T.ArrayType(_loose(EVENT)))])


def loose_part(text: Column, schema: T.StructType) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _loose(schema)))


def frame_by_parts(text: Column) -> Column:
    """A frame whose parts are parsed each on its own: a stray snapshot or event is NULL."""
    frame = F.from_json(text, RAW_FRAME)
    return F.when(F.ltrim(text).startswith("{"), F.struct(
        frame.timestamp.alias("timestamp"),
        F.transform_values(frame.participantFrames, lambda _, x: loose_part(x, PARTICIPANT_FRAME)).alias("participantFrames"),
        F.transform(frame.events, lambda x: loose_part(x, EVENT)).alias("events")))


def with_objects(df: DataFrame, texts: str, out: str, schema: T.StructType, by_parts) -> DataFrame:
    """Add ``out``: the elements of ``texts`` as objects, parsed in one go for a row whose elements all
    fit ``schema``; the elements of any other row are parsed each on its own by ``by_parts``."""
    made = T.StructType([T.StructField("each", T.ArrayType(schema)), T.StructField("_corrupt_record", _S)])
    one = F.concat(F.lit('{"each":['), F.array_join(texts, ","), F.lit("]}"))
    whole = F.when(F.forall(texts, lambda x: F.ltrim(x).startswith("{")),
                   F.from_json(one, made, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    fits = F.col("_whole").isNotNull() & F.col("_whole._corrupt_record").isNull() & (F.size("_whole.each") == F.size(texts))
    return (df.withColumn("_whole", whole)
            .withColumn(out, F.when(fits, F.col("_whole.each")).otherwise(F.transform(texts, by_parts))).drop("_whole"))


def parsed_each(texts: Column, schema: T.StructType) -> Column:
    return F.filter(F.transform(F.coalesce(texts, F.array().cast(TEXTS)), lambda x: parsed(x, schema)),
                    lambda x: x.isNotNull())


# ---------------------------------------------------------------- S1/S2 ----
def _key_and_kind(name: Column) -> tuple[Column, Column]:
    """doc_key and kind that a file's name gives in the ``files`` layout."""
    return (F.regexp_extract(name, r"^(.*?)(_timeline)?\.json$", 1).alias("doc_key"),
            F.when(name.endswith("_timeline.json"), F.lit("timeline")).otherwise(F.lit("detail")).alias("kind"))


def document_columns(raw: DataFrame, layout: str) -> list[Column]:
    """doc_key, kind, file_name and path of documents read with DOC_SCHEMA."""
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    if layout == "files":
        key, kind = _key_and_kind(name)
    elif layout == "lines":
        kind = F.when(path.contains("/timeline/"), F.lit("timeline")).otherwise(F.lit("detail"))
        key = F.col("metadata.matchId")
    else:
        raise ValueError("layout must be 'files' or 'lines'")
    return [key.alias("doc_key"), kind.alias("kind"), name.alias("file_name"), path.alias("path"),
            F.col("_metadata.file_block_start").alias("block")]


def with_arrival(docs: DataFrame, run: int | Column = 0, row: Column | None = None, *more: str) -> DataFrame:
    """Order of arrival: run, then file path, then place in the file (or ``row``, where a stream has no places)."""
    place = F.struct(F.lit(run).cast("long").alias("run"), "path", "block",
                     (F.monotonically_increasing_id() if row is None else row).alias("row")).alias("arrival")
    return docs.select("doc_key", "kind", "file_name", place, "metadata", "info", "_corrupt_record", *more)


def _elements(text: str) -> list[str]:
    """The documents of one file: the text itself, or each element's of a list; a broken list is one broken document."""
    if not text.lstrip().startswith("["):
        return [text]
    out, scan, at = [], json.JSONDecoder(), text.index("[") + 1
    try:
        while text[at:].lstrip()[:1] != "]" or out and text[:at].rstrip().endswith(","):
            at = len(text) - len(text[at:].lstrip())
            end = scan.raw_decode(text, at)[1]
            out.append(text[at:end])
            at = len(text) - len(text[end:].lstrip())
            if text[at] == "]":
                break
            if text[at] != ",":
                return [text]
            at += 1
    except (ValueError, IndexError):
        return [text]
    return out


def _file_system(path: str):
    """(file system, root) of a path, None if pyarrow does not know its scheme."""
    from pyarrow import fs
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def read_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, file_name, value): the texts of all ``*.json`` files under a folder, however many there are.

    Spark's reader lists and plans every file on the driver. Here tasks do: one
    lists the folder, others its sub-folders, and the names are dealt evenly to
    those that read. None where only Spark knows the path's file system."""
    if _file_system(path) is None:
        return None

    def listed(batches):
        from pyarrow import fs
        where, _ = _file_system(path)
        for batch in batches:
            names, folders = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(n, f) for n, f in zip(names, folders) if not f]
            for n in (n for n, f in zip(names, folders) if f):
                for x in where.get_file_info(fs.FileSelector(n)):
                    folder = x.type == fs.FileType.Directory
                    if x.base_name[:1] not in "._" and (folder or x.base_name.endswith(".json")):
                        found.append((x.path, folder))
            for i in range(0, len(found), 10_000):
                names, folders = zip(*found[i:i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())], names=["path", "folder"])

    def deep(batches):
        for batch in batches:
            todo = [batch]
            while todo:
                for out in listed([todo.pop()]):
                    files = out.filter(pa.compute.invert(out.column(1)))
                    if files.num_rows:
                        yield files
                    if files.num_rows < out.num_rows:
                        todo.append(out.filter(out.column(1)))

    def texts(batches):
        where, _ = _file_system(path)
        schema = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("value", pa.string())])
        for batch in batches:
            rows, size = [], 0
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(name) as f:
                    raw = f.read()
                for text in _elements(raw.decode(json.detect_encoding(raw), errors="replace")):
                    rows.append((name, name.rsplit("/", 1)[-1], text))
                    size += len(text)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], schema=schema)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = "path string, folder boolean"
    return (spark.createDataFrame([(_file_system(path)[1], True)], names).coalesce(1).mapInArrow(listed, names)
            .repartition(n).mapInArrow(deep, names).repartition(n).mapInArrow(texts, "path string, file_name string, value string"))


def read_documents(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """All documents under ``path`` as rows: doc_key, kind ('detail'|'timeline'),
    file_name, arrival, metadata, info, _corrupt_record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    reader = spark.read.schema(DOC_SCHEMA).options(**options)
    files = read_files(spark, path) if layout == "files" else None
    if files is not None:
        doc = F.from_json("value", DOC_SCHEMA, options)
        found = files.select("path", "file_name", doc.alias("doc")).where("doc IS NOT NULL")
        return with_arrival(found.select(*_key_and_kind(F.col("file_name")), "file_name", "path",
                                         F.lit(0).cast("long").alias("block"), "doc.*"))
    if layout == "files":
        raw = reader.option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
        return with_arrival(raw.select(*document_columns(raw, layout), "metadata", "info", "_corrupt_record"))
    # a scan for each kind: who asks for one kind does not parse the other
    sides = []
    for kind in ("detail", "timeline"):
        raw = reader.option("recursiveFileLookup", True).json(f"{path.rstrip('/')}/{kind}")
        columns = [F.lit(kind).alias("kind") if at == 1 else c for at, c in enumerate(document_columns(raw, layout))]
        sides.append(with_arrival(raw.select(*columns, "metadata", "info", "_corrupt_record")))
    return sides[0].unionByName(sides[1])


# ---------------------------------------------------------------- S3/S4 ----
def _first(df: DataFrame, key: str) -> DataFrame:
    """The first arrival of each key (``row_number() = 1`` is cut down before the shuffle)."""
    w = Window.partitionBy(key).orderBy("arrival")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def seats(people: Column) -> Column:
    """Participants with an id, the first of each."""
    ids = F.transform(people, lambda p: p.puuid)
    return F.filter(people, lambda p, i: p.puuid.isNotNull() & (F.array_position(ids, p.puuid) == i + 1))


def null_counter(texts: Column, player: Column) -> Column:
    """True if the player's participant has a counter that is there and null (a missing one is not)."""
    own = F.try_element_at(F.filter(F.coalesce(texts, F.array().cast(TEXTS)), lambda x: F.ltrim(x).startswith("{") & (
        F.get_json_object(x, "$.puuid") == player)), F.lit(1))
    value, found = F.try_parse_json(own), F.lit(False)
    for name in COUNTERS:
        found = found | F.coalesce(F.is_variant_null(F.try_variant_get(value, f"$.{name}", "variant")), F.lit(False))
    return found


def pair_documents(docs: DataFrame, player: str | Column, rival_position: str = RIVAL_POSITION,
                   strict: bool = False) -> dict[str, DataFrame]:
    """Paired (detail, timeline) rows with the reason why a document can't be used.

    ``player``: the tracked player's id, or a column that gives it for each
    document (several tracked players); a document that does not list it is
    rejected, never read for somebody else. EVERY makes a row for each player of
    a document; its session id is then the document's with the player's behind it,
    so that every table, window and join keeps its one key. Frames and events of a
    timeline are parsed once: before its players are told apart, else after the
    pairing, of usable documents only.

    * malformed JSON, missing required fields, player absent, participant id
      absent, frames not a list  -> quarantine with a reason;
    * a counter of the player that is null: 0 like a missing one; with ``strict``
      -> quarantine 'null counter', as in the analysed application;
    * detail without timeline -> quarantine 'timeline missing' (retried later);
    * timeline without detail -> ignored (``orphans`` for inspection).
    """
    if player is None:
        raise ValueError("name the tracked player")
    every = isinstance(player, str) and player == EVERY
    details = docs.where(F.col("kind") == "detail")
    # The malformed test also reads ``info.frames`` (a size can never be < 0):
    # Spark refuses scans whose only parsed column is the corrupt-record column,
    # because the parser would then skip the records it is asked to judge.
    no_frames = F.array().cast(TEXTS)
    t_bad = F.col("_corrupt_record").isNotNull() | (F.size(F.coalesce(F.col("info.frames"), no_frames)) < 0)
    timelines = _first(docs.where(F.col("kind") == "timeline").select(
        "doc_key", "arrival", F.col("info.frames").alias("frames"), t_bad.alias("_t_corrupt"),
        F.col("file_name").alias("timeline_file")), "doc_key")
    if every:
        timelines = parse_frames(timelines)
    d = with_objects(details.withColumn("_texts", F.coalesce("info.participants", no_frames)), "_texts", "_people",
                     _loose(PARTICIPANT), lambda x: loose_part(x, PARTICIPANT)).drop("_texts")
    d = d.withColumn("_people", F.transform(F.filter("_people", lambda p: p.isNotNull()), lambda p: p.cast(PARTICIPANT)))
    match_id = F.col("metadata.matchId")
    if every:
        d = d.withColumn("own", F.explode_outer(seats(F.col("_people")))).withColumn("player", F.col("own.puuid"))
        match_id = F.concat(match_id, F.lit(SEAT), "player")
    else:
        d = (d.withColumn("player", F.lit(player) if isinstance(player, str) else player)
             .withColumn("own", F.try_element_at(F.filter("_people", lambda p: p.puuid == F.col("player")), F.lit(1))))
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed document"))
              .when(F.col("metadata.matchId").isNull() | F.col("info.gameCreation").isNull()
                    | F.col("info.gameVersion").isNull(), F.lit("missing required field"))
              .when(F.col("info.participants").isNull(), F.lit("participants not a list"))
              .when(F.col("own").isNull(), F.lit("player not found"))
              .when(F.col("own.participantId").isNull(), F.lit("participant id missing"))
              .when(F.col("own.championName").isNull() | F.col("own.win").isNull(), F.lit("missing required field")))
    if strict:
        reason = reason.when(null_counter(F.col("info.participants"), F.col("player")), F.lit("null counter"))
    rival = F.try_element_at(F.filter(
        "_people",
        lambda p: (F.coalesce(p.teamId, F.lit(0)) != F.coalesce(F.col("own.teamId"), F.lit(0)))
        & (F.coalesce(F.nullif(p.individualPosition, F.lit("")), p.teamPosition) == rival_position)), F.lit(1))
    d = d.withColumn("_reason", reason).withColumn("_rival", rival)
    # only what the three tables need goes on, of a rejected document its reason
    d = d.select("doc_key", "file_name", "arrival", "player", *[F.when(F.col("_reason").isNull(), F.col(c)).alias(c) for c in ("own", "_rival")], "_reason",
                 match_id.alias("match_id"), F.col("info.gameCreation").cast("long").alias("created"),
                 F.col("info.gameVersion").alias("version"), F.col("info.gameDuration").cast("int").alias("duration"),
                 F.col("info.queueId").cast("int").alias("queue"))
    joined = d.join(timelines.drop("arrival"), "doc_key", "left")
    t_reason = (F.when(F.col("timeline_file").isNull(), F.lit("timeline missing"))
                .when(F.col("_t_corrupt"), F.lit("malformed timeline")))
    joined = joined.withColumn("_reason", F.coalesce(F.col("_reason"), t_reason))
    if not every:       # a document that is rejected needs no frames
        joined = parse_frames(joined.withColumn("frames", F.when(F.col("_reason").isNull(), F.col("frames"))))
    orphans = timelines.join(details.select("doc_key"), "doc_key", "left_anti").select("doc_key", "timeline_file")
    return {"joined": joined, **split_pairs(joined), "orphans": orphans}


def split_pairs(joined: DataFrame) -> dict[str, DataFrame]:
    """The first usable document of each session (``pairs``), all usable ones
    (``usable``) and the quarantine (doc_key, file_name, reason)."""
    usable = joined.where(F.col("_reason").isNull()).drop("_reason", "_t_corrupt")
    return {"pairs": _first(usable, "match_id"), "usable": usable,
            "quarantine": joined.where(F.col("_reason").isNotNull()).select(
                "doc_key", "file_name", F.col("_reason").alias("reason"))}


# ---------------------------------------------------------------- P2-P5 ----
def session_facts(pairs: DataFrame) -> DataFrame:
    """27-column session row from the detail document (one ``select``)."""
    own = F.col("own")
    k, d, a = (F.coalesce(own[c], F.lit(0)) for c in ("kills", "deaths", "assists"))
    cs = F.coalesce(own.totalMinionsKilled, F.lit(0)) + F.coalesce(own.neutralMinionsKilled, F.lit(0))
    dur = F.coalesce(F.col("duration"), F.lit(0))
    r = F.col("_rival")
    has_r = r.isNotNull()
    out = pairs.select(
        "match_id", F.col("player").alias("puuid"),
        from_epoch_ms(F.col("created")).alias("game_datetime"),
        major_minor(F.col("version")).alias("game_version"),
        F.coalesce(F.col("queue"), F.lit(0)).alias("queue_id"), dur.alias("game_duration_sec"),
        F.coalesce(own.championId, F.lit(0)).alias("champion_id"), own.championName.alias("champion_name"),
        F.coalesce(own.teamId, F.lit(0)).alias("team_id"),
        first_present(own.teamPosition, own.individualPosition).alias("team_position"),
        F.nullif(own.lane, F.lit("")).alias("lane"), own.win.alias("win"),
        k.alias("kills"), d.alias("deaths"), a.alias("assists"),
        ((k + a) / F.greatest(d, F.lit(1))).alias("kda"), cs.alias("cs_total"),
        per_minute(cs, dur).alias("cs_per_min"),
        F.coalesce(own.goldEarned, F.lit(0)).alias("gold_earned"),
        F.coalesce(own.totalDamageDealtToChampions, F.lit(0)).alias("damage_dealt_to_champions"),
        F.coalesce(own.visionScore, F.lit(0)).alias("vision_score"),
        r.championName.alias("opp_champion_name"),
        F.when(has_r, F.coalesce(r.totalMinionsKilled, F.lit(0)) + F.coalesce(r.neutralMinionsKilled, F.lit(0)))
        .alias("opp_cs_total"),
        F.when(has_r, F.coalesce(r.goldEarned, F.lit(0))).alias("opp_gold_earned"),
        F.when(has_r, F.coalesce(r.kills, F.lit(0))).alias("opp_kills"),
        F.when(has_r, F.coalesce(r.deaths, F.lit(0))).alias("opp_deaths"),
        F.when(has_r, F.coalesce(r.assists, F.lit(0))).alias("opp_assists"))
    return conform(out, sessions_schema())


def parse_frames(timelines: DataFrame) -> DataFrame:
    """``frames`` (texts) as ``_fr`` (time and snapshots by participant id) and ``_ev`` (events of each frame)."""
    none = F.array().cast(WHOLE_FRAME["events"].dataType)
    events = F.transform("_fr", lambda f: F.transform(
        F.filter(F.coalesce(f.events, none), lambda e: e.isNotNull()), lambda e: e.cast(EVENT)))
    kept = F.transform("_fr", lambda f: F.struct(f.timestamp.alias("timestamp"), f.participantFrames.alias("participantFrames")))
    return (with_objects(timelines, "frames", "_fr", WHOLE_FRAME, frame_by_parts)
            .withColumn("_fr", F.filter("_fr", lambda f: f.isNotNull())).withColumn("_ev", events)
            .withColumn("_fr", kept).drop("frames"))


def with_snapshots(pairs: DataFrame, tick_ms: int = 60_000) -> DataFrame:
    """Add ``_snaps``: per tick, the player's last snapshot with the running
    kill count (W1: frames lacking the player's snapshot still add their kills;
    W2: the last frame inside a tick wins), and ``_deaths``: the player's
    incident events in document order.

    Every array is consumed only as the *input* of a higher-order function,
    never referenced inside a lambda (Spark would re-evaluate it per element),
    so each step is linear in the frames, and the last-per-tick rule quadratic in
    the ticks of one document (some tens)."""
    pid = F.col("own.participantId")
    key = pid.cast("string")
    frames = F.col("_fr")
    # the player's part in a frame: kills, deaths and snapshot
    kills = F.transform("_ev", lambda es: F.size(F.filter(
        es, lambda e: (e.type == KILL_EVENT) & (e.killerId == pid))))
    start = F.named_struct(F.lit("s"), F.lit(0), F.lit("out"), F.array().cast("array<int>"))
    running = F.aggregate(F.col("_kpf"), start,
                          lambda acc, x: F.named_struct(F.lit("s"), acc.s + x,
                                                        F.lit("out"), F.concat(acc.out, F.array(acc.s + x))),
                          lambda acc: acc.out)
    zipped = F.arrays_zip(frames.alias("f"), F.col("_run").alias("k"))
    snaps = F.filter(F.transform(zipped, lambda z, i: F.named_struct(
        F.lit("pos"), i,
        F.lit("tick"), F.floor(F.coalesce(z.f.timestamp.cast("long"), F.lit(0)) / F.lit(tick_ms)).cast("int"),
        F.lit("pf"), F.try_element_at(z.f.participantFrames, key).cast(PARTICIPANT_FRAME),
        F.lit("kills"), z.k)), lambda s: s.pf.isNotNull())
    snap_type = "array<struct<pos:int,tick:int,pf:{},kills:int>>".format(PARTICIPANT_FRAME.simpleString())
    last = F.aggregate(F.col("_present"), F.array().cast(snap_type),
                       lambda acc, s: F.concat(F.filter(acc, lambda a: a.tick != s.tick), F.array(s)))
    deaths = F.flatten(F.transform("_ev", lambda es: F.filter(
        es, lambda e: (e.type == KILL_EVENT) & (e.victimId == pid))))
    return (pairs.withColumn("_kpf", kills).withColumn("_run", running).withColumn("_present", snaps)
            .withColumn("_snaps", last).withColumn("_deaths", deaths)
            .drop("_fr", "_ev", "_kpf", "_run", "_present"))


def tick_rows(pairs: DataFrame, tick_ms: int = 60_000) -> DataFrame:
    """One row per (session, tick): the last snapshot inside the tick."""
    if "_snaps" not in pairs.columns:
        pairs = with_snapshots(pairs, tick_ms)
    rows = pairs.select("match_id", F.explode("_snaps").alias("s"))
    pf = F.col("s.pf")
    out = rows.select(
        "match_id", F.col("s.tick").alias("timestamp_min"), F.coalesce(pf.totalGold, F.lit(0)).alias("gold"),
        (F.coalesce(pf.minionsKilled, F.lit(0)) + F.coalesce(pf.jungleMinionsKilled, F.lit(0))).alias("cs"),
        F.coalesce(pf.xp, F.lit(0)).alias("xp"), F.col("s.kills").alias("kills"),
        pf.position.x.alias("position_x"), pf.position.y.alias("position_y"))
    return conform(out, TICKS_SCHEMA)


def incident_rows(pairs: DataFrame, tick_ms: int = 60_000) -> DataFrame:
    """Incidents in document order (frame position, then event position),
    numbered from 1, with the snapshot of the incident's own tick (J6)."""
    if "_snaps" not in pairs.columns:
        pairs = with_snapshots(pairs, tick_ms)
    rows = pairs.select("match_id", "_snaps",
                        F.posexplode("_deaths").alias("n", "e"))
    ms = F.coalesce(F.col("e.timestamp"), F.lit(0))
    tick = F.floor(ms / F.lit(tick_ms)).cast("int")
    staged = rows.select("match_id", "n", ms.alias("ms"), tick.alias("tick"),
                         F.try_element_at(F.filter("_snaps", lambda s: s.tick == tick), F.lit(1)).alias("snap"))
    snap = F.col("snap")
    has = snap.isNotNull()
    out = staged.select("match_id", (F.col("n") + 1).alias("death_number"), F.col("ms").alias("timestamp_ms"),
                        F.col("tick").alias("timestamp_min"),
                        F.when(has, F.coalesce(snap.pf.totalGold, F.lit(0))).alias("gold_at_death"),
                        F.when(has, F.coalesce(snap.pf.minionsKilled, F.lit(0))
                               + F.coalesce(snap.pf.jungleMinionsKilled, F.lit(0))).alias("cs_at_death"))
    return conform(out, INCIDENTS_SCHEMA)


def flatten(docs: DataFrame, player: str | Column, tick_ms: int = 60_000) -> dict[str, DataFrame]:
    p = pair_documents(docs, player)
    return flatten_joined(with_snapshots(p["joined"], tick_ms), tick_ms) | {"orphans": p["orphans"]}


def flatten_joined(joined: DataFrame, tick_ms: int = 60_000) -> dict[str, DataFrame]:
    """The three tables and the quarantine from one paired (and snapshotted)
    frame - persist ``joined`` once and every output reads it."""
    sp = split_pairs(joined)
    pairs = sp["pairs"]
    return {"sessions": session_facts(pairs), "ticks": tick_rows(pairs, tick_ms),
            "incidents": incident_rows(pairs, tick_ms), "quarantine": sp["quarantine"],
            "pairs": pairs, "usable": sp["usable"], "joined": joined}
