"""Tables as Parquet folders, versions as rows of one commit table (K1-K4, K8).

Spark writes both. A commit writes the rows of each table into a folder of its
own, dealt by BUCKET (a hash of the session key), then appends one row per table to
the commit table, in one file: until then no reader sees the folders. A table
is what its commits since the last replacement hold. One writer at a time; a
commit with the name of an earlier one does nothing, so a replayed batch is no
second one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

KEYS = ("entity", "match_id", "doc_key")      # a table is dealt by the first of these that it has
BUCKET, COMMIT = "bucket", "commit"
BUCKETS = 64
COMMITS = "version long, commit string, table_name string, replaces boolean, buckets int, columns string"


def dealt_by(columns) -> str | None:
    return next((k for k in KEYS if k in columns), None)


class TableStore:
    """Several tables under one root folder (shared storage). ``buckets`` is fixed by the first commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets, self._rows = spark, root.rstrip("/"), buckets, None

    def _commits(self) -> list:
        """Rows of the commit table in order: metadata, one row per commit and table."""
        if self._rows is None:
            try:
                self._rows = self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits").orderBy("version").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                self._rows = []
        return self._rows

    def refresh(self) -> None:
        """Look at the commit table again (another command may have committed)."""
        self._rows = None

    def version(self) -> int:
        return max((r["version"] for r in self._commits()), default=0)

    def _live(self, upto: int | None = None) -> dict[str, list]:
        out: dict[str, list] = {}
        for r in self._commits():
            if upto is not None and r["version"] > upto:
                break
            out[r["table_name"]] = [*([] if r["replaces"] else out.get(r["table_name"], [])), r]
        return out

    def tables(self) -> list[str]:
        return sorted(self._live())

    @property
    def buckets(self) -> int:
        return self._commits()[0]["buckets"] if self._commits() else self._buckets

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def last_commit(self, table: str):
        """The row of the commit table that last touched a table, None if there is none."""
        return next((r for r in reversed(self._commits()) if r["table_name"] == table), None)

    def replaced_after(self, table: str, version: int) -> bool:
        return any(r["table_name"] == table and r["replaces"] and r["version"] > version for r in self._commits())

    def read(self, table: str, buckets=None, after: int = 0, upto: int | None = None) -> DataFrame | None:
        """The table, None if there is none; with ``buckets`` only the files of these,
        with ``after`` / ``upto`` only what versions after / up to that one added."""
        commits = [r for r in self._live(upto).get(table, ()) if r["version"] > after]
        if not commits:
            return None
        columns = T.StructType.fromJson(json.loads(commits[-1]["columns"]))
        dealt = dealt_by(columns.fieldNames())
        placed = T.StructType([*columns.fields, T.StructField(COMMIT, T.StringType()), *([T.StructField(BUCKET, T.IntegerType())] if dealt else [])])
        top = f"{self.root}/data/{table}"
        df = self.spark.read.schema(placed).option("basePath", top).parquet(*[f"{top}/{COMMIT}={r['commit']}" for r in commits])
        if buckets is not None and dealt:
            df = df.where(F.col(BUCKET).isin(sorted(buckets)))
        return df.select(*columns.fieldNames())

    def commit(self, frames: dict[str, DataFrame], mode: str = "append", replace=(), name: str | None = None) -> int:
        """Write all frames, then publish them together as one version.

        ``append`` adds rows to tables, ``replace`` makes the frames the whole
        tables; ``replace=`` names tables replaced in append mode too."""
        if mode not in ("append", "replace"):
            raise ValueError("mode must be 'append' or 'replace'")
        name = f"c-{name or uuid.uuid4().hex[:12]}"
        if any(r["commit"] == name for r in self._commits()):
            return self.version()
        n, version = self.buckets, self.version() + 1
        for table, df in frames.items():
            key = dealt_by(df.columns)
            out = df.withColumn(BUCKET, self.bucket(key)).repartition(BUCKET).write.partitionBy(BUCKET) if key else df.write
            out.mode("overwrite").parquet(f"{self.root}/data/{table}/{COMMIT}={name}")  # over what a failed try may have left
        rows = [(version, name, t, mode == "replace" or t in replace, n, df.schema.json()) for t, df in frames.items()]
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        self.refresh()
        return version


def absent_rows(frames: dict[str, DataFrame], store: TableStore, keys: dict[str, tuple],
                at_hand: DataFrame | None = None) -> dict[str, DataFrame]:
    """K1: of each frame the rows whose key its table does not hold yet (the first write wins).

    Only files of the buckets that the new rows fall into are read (at most
    ``store.buckets`` numbers reach the driver), of them only the keys, and of
    these only those of the sessions at hand are compared; nothing is read for
    tables without rows. ``keys``: the columns of each table's key, the one it is
    dealt by first. ``at_hand``: the values of that column in all frames, where
    they are known (one column; values may repeat)."""
    held = [t for t in frames if t in store.tables() and not store.read(t).isEmpty()]
    if not held:
        return dict(frames)
    if at_hand is None:
        parts = [frames[t].select(keys[t][0]) for t in held]
        at_hand = parts[0]
        for p in parts[1:]:
            at_hand = at_hand.unionByName(p)
    at_hand, key = at_hand.distinct(), at_hand.columns[0]
    at = [r[0] for r in at_hand.select(store.bucket(key)).distinct().collect()]
    out = dict(frames)
    for table in held:
        known = store.read(table, at).select(*keys[table]).join(at_hand, key, "left_semi")
        out[table] = frames[table].join(known, list(keys[table]), "left_anti")
    return out


def ensure_tables(store: TableStore, schemas: dict | None = None) -> int:
    """Create-if-absent plus a column-contract check of existing tables
    (K6/K7, the schema-initialisation step): missing tables are committed
    empty with their declared schema in one version; an existing table whose
    column set differs raises ``SchemaContractError`` with sorted missing and
    unexpected names. Returns the store version."""
    from playline.schemas import DECLARED, assert_columns, assert_types
    schemas = schemas or {t: DECLARED[t] for t in ("sessions", "ticks", "incidents")}
    present = store.tables()
    for name, schema in schemas.items():
        if name in present:
            assert_columns(store.read(name), name, schema.fieldNames())
            assert_types(store.read(name), name, schema)
    missing = {n: store.spark.createDataFrame([], sch) for n, sch in schemas.items() if n not in present}
    return store.commit(missing) if missing else store.version()
