"""Table contracts: declared schemas, key/NOT NULL rules and checks (K6, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Table and column names of the session data model.
SESSION_COLUMNS = (
    "match_id", "puuid", "game_datetime", "game_version", "queue_id",
    "game_duration_sec", "champion_id", "champion_name", "team_id",
    "team_position", "lane", "win", "kills", "deaths", "assists", "kda",
    "cs_total", "cs_per_min", "gold_earned", "damage_dealt_to_champions",
    "vision_score", "opp_champion_name", "opp_cs_total", "opp_gold_earned",
    "opp_kills", "opp_deaths", "opp_assists",
)
TICK_COLUMNS = ("match_id", "timestamp_min", "gold", "cs", "xp", "kills", "position_x", "position_y")
INCIDENT_COLUMNS = ("match_id", "death_number", "timestamp_ms", "timestamp_min", "gold_at_death", "cs_at_death")
FEATURE_MATRIX_COLUMNS = (
    "match_id", "win", "game_datetime", "champion_name", "tilt_index",
    "hour_of_day", "day_of_week", "is_weekend", "time_bucket", "is_throw",
    "is_comeback", "gold_delta", "total_deaths", "deaths_while_ahead",
    "tilt_spiral_ratio", "max_death_streak", "total_roams",
    "avg_cs_sacrifice", "roam_impact_rate",
)
LABEL_COLUMNS = ("match_id", "cluster_id")

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


def sessions_schema(ts_type: T.DataType = T.TimestampNTZType()) -> T.StructType:
    return _struct([
        ("match_id", _S, False), ("puuid", _S, False), ("game_datetime", ts_type, False),
        ("game_version", _S, False), ("queue_id", _I, False), ("game_duration_sec", _I, False),
        ("champion_id", _I, False), ("champion_name", _S, False), ("team_id", _I, False),
        ("team_position", _S, True), ("lane", _S, True), ("win", _B, False),
        ("kills", _I, False), ("deaths", _I, False), ("assists", _I, False), ("kda", _D, False),
        ("cs_total", _I, False), ("cs_per_min", _D, False), ("gold_earned", _L, False),
        ("damage_dealt_to_champions", _L, False), ("vision_score", _I, False),
        ("opp_champion_name", _S, True), ("opp_cs_total", _I, True), ("opp_gold_earned", _L, True),
        ("opp_kills", _I, True), ("opp_deaths", _I, True), ("opp_assists", _I, True),
    ])


TICKS_SCHEMA = _struct([
    ("match_id", _S, False), ("timestamp_min", _I, False), ("gold", _L, False), ("cs", _I, False),
    ("xp", _I, False), ("kills", _I, False), ("position_x", _I, True), ("position_y", _I, True),
])
INCIDENTS_SCHEMA = _struct([
    ("match_id", _S, False), ("death_number", _I, False), ("timestamp_ms", _L, False),
    ("timestamp_min", _I, False), ("gold_at_death", _L, True), ("cs_at_death", _I, True),
])
LABELS_SCHEMA = _struct([("match_id", _S, False), ("cluster_id", _I, False)])

PRIMARY_KEYS = {
    "sessions": ("match_id",),
    "ticks": ("match_id", "timestamp_min"),
    "incidents": ("match_id", "death_number"),
    "feature_matrix": ("match_id",),
    "cluster_labels": ("match_id",),
}
DECLARED = {
    "sessions": sessions_schema(),
    "ticks": TICKS_SCHEMA,
    "incidents": INCIDENTS_SCHEMA,
    "cluster_labels": LABELS_SCHEMA,
}
COLUMNS = {
    "sessions": SESSION_COLUMNS,
    "ticks": TICK_COLUMNS,
    "incidents": INCIDENT_COLUMNS,
    "feature_matrix": FEATURE_MATRIX_COLUMNS,
    "cluster_labels": LABEL_COLUMNS,
}


class SchemaContractError(RuntimeError):
    """A table's column set differs from its declared contract."""


def schema_diff(actual, expected) -> tuple[list[str], list[str]]:
    """Sorted (missing, unexpected) column names; a driver-side set diff of metadata only."""
    a, e = set(actual), set(expected)
    return sorted(e - a), sorted(a - e)


def assert_types(df: DataFrame, name: str, schema: T.StructType) -> None:
    """Every declared column has its declared type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have[f.name].simpleString()}, declared {f.dataType.simpleString()}"
             for f in schema.fields if f.name in have and have[f.name] != f.dataType]
    if wrong:
        raise SchemaContractError(f"{name} breaks its type contract ({'; '.join(wrong)})")


def assert_columns(df: DataFrame, name: str, expected) -> None:
    missing, unexpected = schema_diff(df.columns, expected)
    if missing or unexpected:
        raise SchemaContractError(
            f"{name} breaks its column contract (absent: {missing}, not declared: {unexpected})")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to a declared schema (column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def contract_violations(df: DataFrame, schema: T.StructType, keys) -> DataFrame:
    """One-pass violation report: NULLs in NOT NULL columns and duplicate keys.

    Returns one row per rule with its violation count (``rule``, ``violations``).
    The duplicate-key count is a grouped aggregate with map-side combine, so a
    hot key costs one partial-aggregate row per map task, not a shuffle of it.
    """
    required = [f.name for f in schema.fields if not f.nullable]
    null_aggs = [F.sum(F.col(c).isNull().cast("long")).alias(f"not_null:{c}") for c in required]
    nulls = df.agg(*null_aggs) if null_aggs else None
    dup = (df.groupBy(*keys).count().where("count > 1")
           .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("pk:" + ",".join(keys))))
    parts = []
    if nulls is not None:
        parts.append(nulls.unpivot([], [F.col(f"`{c}`") for c in nulls.columns], "rule", "violations"))
    parts.append(dup.unpivot([], [F.col(f"`{c}`") for c in dup.columns], "rule", "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
