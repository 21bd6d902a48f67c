"""Landing-side operators: skip-already-landed, ordered key de-duplication,
candidate filter and completeness status (S6-S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def new_keys(candidates: DataFrame, landed: DataFrame, key: str = "match_id") -> DataFrame:
    """Skip-already-landed: candidate keys whose document is not landed yet."""
    return candidates.join(landed.select(key), key, "left_anti")


def first_n_distinct(candidates: DataFrame, key: str, pos: str, n: int) -> DataFrame:
    """Order-preserving de-duplication across pages, then the first ``n`` keys.

    ``min(pos)`` per key is a partial aggregate; ``limit`` after ``orderBy``
    is a top-n (TakeOrderedAndProject), the truncation is the feature."""
    return (candidates.groupBy(key).agg(F.min(pos).alias(pos))
            .orderBy(pos, key).limit(n))


def candidate_filter(candidates: DataFrame, queue_id: int | None = None, start=None, end=None,
                     queue_col: str = "queue_id", ts_col: str = "game_datetime") -> DataFrame:
    c = candidates
    if queue_id is not None:
        c = c.where(F.col(queue_col) == queue_id)
    if start is not None:
        c = c.where(F.col(ts_col) >= F.lit(start).cast(c.schema[ts_col].dataType))
    if end is not None:
        c = c.where(F.col(ts_col) <= F.lit(end).cast(c.schema[ts_col].dataType))
    return c


def landing_status(keys: DataFrame, before: DataFrame, after: DataFrame, key: str = "match_id") -> DataFrame:
    """Per key: saved / skipped / timeline missing / detail missing / missing.

    ``before``/``after``: inventories (key, kind) of landed documents before
    and after a collection run."""
    def flags(inv, suffix):
        return inv.groupBy(key).agg(
            F.max((F.col("kind") == "detail").cast("int")).cast("boolean").alias(f"detail_{suffix}"),
            F.max((F.col("kind") == "timeline").cast("int")).cast("boolean").alias(f"timeline_{suffix}"))
    j = keys.select(key).join(flags(before, "before"), key, "left").join(flags(after, "after"), key, "left")
    had_d, had_t = F.coalesce("detail_before", F.lit(False)), F.coalesce("timeline_before", F.lit(False))
    ok_d, ok_t = F.coalesce("detail_after", F.lit(False)), F.coalesce("timeline_after", F.lit(False))
    status = (F.when(ok_d & ok_t, F.when(had_d & had_t, F.lit("skipped")).otherwise(F.lit("saved")))
              .when(ok_d, F.lit("timeline missing")).when(ok_t, F.lit("detail missing")).otherwise(F.lit("missing")))
    return j.select(key, status.alias("status"))
