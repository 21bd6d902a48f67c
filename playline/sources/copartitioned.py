"""Session tables dealt alike by the session's key.

Written once with Spark's bucketing: every table has the same number of buckets
over ``match_id``, each bucket sorted by it, one file per bucket. Joins of these
tables on the session, and windows and aggregates by session, then need no
exchange: swing games, incident context and excursions read ticks and incidents
and never shuffle them (``plans/dealt.py``; ``tests/test_copartitioned.py`` asserts
it). Runs of incidents still go through buckets of their own, which has no bound
by session.

The bucket count is fixed by the written files. Rows of one session are one
game's minutes, so no bucket is hot; take as many buckets as files of about 1 GB
ask for (Spark allows 100,000 unless spark.sql.sources.bucketing.maxBuckets is raised).

The files are plain Parquet; that they are dealt is known to the catalog only.
``attach`` tells another application's catalog about written files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "match_id"
TABLES = ("sessions", "ticks", "incidents")


def table_name(prefix: str, table: str) -> str:
    return f"{prefix}_{table}"


def write_copartitioned(tables: dict[str, DataFrame], path: str, prefix: str, buckets: int) -> dict[str, DataFrame]:
    """Write tables under ``path`` (shared storage) and return them as read back.

    Rows are dealt by the same hash that buckets use, so each task writes one
    file. A table of that name is replaced as a whole."""
    for name, df in tables.items():
        (df.repartition(buckets, KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
         .option("path", f"{path}/{name}").saveAsTable(table_name(prefix, name)))
    return read_copartitioned(next(iter(tables.values())).sparkSession, prefix, tuple(tables))


def read_copartitioned(spark: SparkSession, prefix: str, tables=TABLES) -> dict[str, DataFrame]:
    return {t: spark.table(table_name(prefix, t)) for t in tables}


def attach(spark: SparkSession, path: str, prefix: str, buckets: int, schemas: dict) -> dict[str, DataFrame]:
    """Make files that another application wrote known to this session's catalog.

    ``buckets`` and ``schemas`` are those they were written with."""
    for name, schema in schemas.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table_name(prefix, name)} ({columns}) USING parquet "
                  f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {int(buckets)} BUCKETS LOCATION '{path}/{name}'")
    return read_copartitioned(spark, prefix, tuple(schemas))
