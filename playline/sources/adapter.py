"""Derive the session data model from the driver's ``events`` table.

The analysed application lands game sessions; the driver tables carry a
generic event stream instead. This adapter maps one (user, 5-day block) to a
session, 6-hour ticks inside the block to tick numbers 0..19, and event types
to the per-session counters, so every operator runs on data whose size grows
with the driver tables.

Rules (one per column) - see FIXTURES.md section B:
  us      = microseconds since 2024-01-01 (zone independent on TIMESTAMP_NTZ)
  blk     = us div 5 days,  tick = (us mod 5 days) div 6 hours
  cents   = round(value * 100),  k = props.k
  session = '<user_id>-<blk>'; order inside a session = (ts, event_id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playline.functions.scalars import micros_since
from playline.operators.sequence import number_rows
from playline.schemas import INCIDENTS_SCHEMA, TICKS_SCHEMA, conform, sessions_schema

# Adapter geometry.
EPOCH = "2024-01-01 00:00:00"
BLOCK_US = 432_000_000_000      # 5 days
TICK_US = 21_600_000_000        # 6 hours
TICK_MS = TICK_US // 1000
POSITION_SCALE = 150
QUEUE_ID = 420


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def event_frame(events: DataFrame) -> DataFrame:
    """Per-event derived columns; projection only (no shuffle)."""
    us = micros_since("ts", EPOCH, events.schema["ts"].dataType.simpleString())
    return (events
            .select("event_id", "ts", "user_id", "event_type", "value", "props", us.alias("us"))
            .withColumn("blk", F.floor(F.col("us") / F.lit(BLOCK_US)).cast("long"))
            .withColumn("off_us", F.col("us") - F.col("blk") * F.lit(BLOCK_US))
            .withColumn("tick", F.floor(F.col("off_us") / F.lit(TICK_US)).cast("int"))
            .withColumn("cents", F.round(F.col("value") * 100).cast("long"))
            .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .withColumn("match_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("blk").cast("string")))
            .withColumn("is_err", F.col("event_type") == "error")
            .withColumn("is_cs", F.col("event_type").isin("view", "click"))
            .withColumn("is_kill", F.col("event_type") == "purchase"))


def sessions(events: DataFrame) -> DataFrame:
    """One row per (user, block) with the 27 session columns; rival columns
    come from session (user XOR 1, block)."""
    ev = event_frame(events)
    own = (ev.groupBy("user_id", "blk").agg(
        F.min("ts").alias("start_ts"),
        F.min("us").alias("us_min"), F.max("us").alias("us_max"),
        F.count_if(F.col("is_kill")).cast("int").alias("kills"),
        F.count_if(F.col("is_err")).cast("int").alias("deaths"),
        F.count_if(F.col("event_type") == "signup").cast("int").alias("assists"),
        F.count_if(F.col("is_cs")).cast("int").alias("cs_total"),
        F.sum("cents").cast("long").alias("gold_earned"),
        F.sum("k").cast("long").alias("damage"),
        F.count(F.lit(1)).cast("int").alias("n_events")))
    dur = F.floor((F.col("us_max") - F.col("us_min")) / F.lit(1_000_000)).cast("int")
    role = F.when((F.col("user_id") + F.col("blk")) % 4 == 3, F.lit("BOTTOM")).otherwise(F.lit("MIDDLE"))
    base = own.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("blk").cast("string")).alias("match_id"),
        "user_id", "blk",
        F.col("user_id").cast("string").alias("puuid"),
        F.col("start_ts").alias("game_datetime"),
        F.concat(F.lit("16."), (((F.col("user_id") + F.col("blk")) % 12) + 1).cast("string")).alias("game_version"),
        F.lit(QUEUE_ID).alias("queue_id"),
        dur.alias("game_duration_sec"),
        (F.col("user_id") % 7).cast("int").alias("champion_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 7).cast("string")).alias("champion_name"),
        (F.lit(100) + F.lit(100) * (F.col("user_id") % 2)).cast("int").alias("team_id"),
        role.alias("team_position"), role.alias("lane"),
        (F.col("kills") >= F.col("deaths")).alias("win"),
        "kills", "deaths", "assists",
        ((F.col("kills") + F.col("assists")) / F.greatest(F.col("deaths"), F.lit(1))).cast("double").alias("kda"),
        "cs_total",
        F.when(dur > 0, F.col("cs_total") / (dur / F.lit(60.0))).otherwise(F.lit(0.0)).alias("cs_per_min"),
        "gold_earned",
        F.col("damage").alias("damage_dealt_to_champions"),
        F.col("n_events").alias("vision_score"))
    # users 2n and 2n + 1 of a block are each other's rival: two neighbours in one window of at most two rows
    w = Window.partitionBy(F.shiftright("user_id", 1), "blk").orderBy("user_id")
    facing = F.struct("champion_name", "cs_total", "gold_earned", "kills", "deaths", "assists")
    met = base.withColumn("_r", F.when(F.col("blk").isNotNull(), F.coalesce(F.lag(facing).over(w), F.lead(facing).over(w))))
    joined = met.select("*", *[F.col(f"_r.{c}").alias(f"opp_{c}") for c in ("champion_name", "cs_total", "gold_earned", "kills", "deaths", "assists")])
    return conform(joined, sessions_schema(events.schema["ts"].dataType))


def _tick_parts(ev: DataFrame) -> DataFrame:
    """Per (session, tick) partial sums plus the last non-error event.

    Pre-aggregating here (map-side combine) bounds every later window to at
    most 20 rows per session, however many events one user produces.
    """
    return ev.groupBy("match_id", "tick").agg(
        F.sum("cents").alias("t_gold"), F.count(F.lit(1)).alias("t_n"),
        F.count_if(F.col("is_cs")).alias("t_cs"), F.count_if(F.col("is_kill")).alias("t_kills"),
        F.max(F.when(~F.col("is_err"), F.struct("ts", "event_id", "k", "user_id"))).alias("last"))


def ticks(events: DataFrame) -> DataFrame:
    """Tick snapshot = running totals at the last non-error event of each tick.

    Running totals count every event (errors included); error events after a
    tick's last non-error event are subtracted again (gold, xp only - errors
    carry no cs or kills). Parts meet these errors where the first aggregate has
    put them, by session and tick; only the window by session moves them again.
    """
    ev = event_frame(events)
    parts = _tick_parts(ev)
    errors = ev.where("is_err").select("match_id", "tick", F.struct("ts", "event_id").alias("at"), "cents")
    late = F.col("at") > F.struct("last.ts", "last.event_id")
    hidden = F.col("last.user_id") % 5 == 0
    met = parts.join(errors, ["match_id", "tick"], "left").groupBy(*parts.columns).agg(
        F.sum(F.when(late, F.col("cents"))).alias("x_gold"), F.count_if(late).alias("x_n"))
    w = Window.partitionBy("match_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    run = (met.select("match_id", "tick", "t_gold", "t_n", "t_cs", "t_kills", "x_gold", "x_n", F.col("last").isNotNull().alias("shown"),
                      F.when(~hidden, F.col("last.k") * POSITION_SCALE).alias("position_x"),
                      F.when(~hidden, ((F.col("last.event_id") * 37) % 100) * POSITION_SCALE).alias("position_y"))
           .withColumn("c_gold", F.sum("t_gold").over(w))
           .withColumn("c_n", F.sum("t_n").over(w))
           .withColumn("c_cs", F.sum("t_cs").over(w))
           .withColumn("c_kills", F.sum("t_kills").over(w))
           .where("shown"))
    out = run.select(
        "match_id", F.col("tick").alias("timestamp_min"),
        (F.col("c_gold") - F.coalesce("x_gold", F.lit(0))).alias("gold"),
        F.col("c_cs").alias("cs"),
        (F.col("c_n") - F.col("x_n")).alias("xp"),
        F.col("c_kills").alias("kills"), "position_x", "position_y")
    return conform(out, TICKS_SCHEMA)


def incidents(events: DataFrame, tick_rows: DataFrame | None = None) -> DataFrame:
    """Error events numbered per session in (ts, event_id) order, with the
    same-tick snapshot (NULL when that tick held only errors)."""
    ev = event_frame(events)
    errs = ev.where("is_err").select("match_id", "ts", "event_id", "off_us", "tick")
    numbered = number_rows(errs, ["match_id"], ["ts", "event_id"], out="death_number")
    snap = (tick_rows if tick_rows is not None else ticks(events)).select(
        "match_id", "timestamp_min", F.col("gold").alias("gold_at_death"), F.col("cs").alias("cs_at_death"))
    out = (numbered.select("match_id", "death_number",
                           F.floor(F.col("off_us") / 1000).cast("long").alias("timestamp_ms"),
                           F.col("tick").alias("timestamp_min"))
           .join(snap, ["match_id", "timestamp_min"], "left"))
    return conform(out, INCIDENTS_SCHEMA)


def fixed_labels(session_rows: DataFrame) -> DataFrame:
    """Deterministic stand-in for clustering output: cluster = user % 4."""
    return session_rows.select("match_id", (F.col("puuid").cast("long") % 4).cast("int").alias("cluster_id"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ev = load_events(spark, sf_dir)
    t = ticks(ev)
    return {"sessions": sessions(ev), "ticks": t, "incidents": incidents(ev, t)}
