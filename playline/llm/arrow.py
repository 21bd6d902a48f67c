"""Small helpers for operators that run numpy inside Arrow-batched tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_CHARS = 1_000_000
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Rows of whole documents are large: tasks get BATCH_ROWS of them at a time, unless the session set a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters (one text at least)."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], dict]], schema: str) -> DataFrame:
    """Append columns computed from ``text`` (null: empty) by ``make()(texts) -> {column: list}``.

    ``make`` runs once a task (tables, caches); its function sees slices of
    about CHUNK_CHARS characters, so memory follows the slice, not the batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != text]
    out_schema = to_arrow_schema(type(df.schema)([*keep, *_parse_datatype_string(schema).fields]))
    new = out_schema.names[len(keep):]
    names = [f.name for f in keep]

    def run(batches):
        work = make()
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            texts = [t or "" for t in cols[text].to_pylist()]
            for i, j in chunks(texts):
                got = work(texts[i:j])
                arrays = [cols[n].slice(i, j - i) for n in names]
                arrays = [a.cast(out_schema.field(k).type) for k, a in enumerate(arrays)]
                arrays += [pa.array(got[n], type=out_schema.field(n).type) for n in new]
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(run, f"{fields}, {schema}" if fields else schema)
