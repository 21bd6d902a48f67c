"""Generic ordered-sequence operators over keyed timelines.

All of them take column names, so they work for any entity/tick table:

* ``nearest_anchor``  - value at the tick closest to a target, inside a window (W4)
* ``bool_islands``    - gaps-and-islands block ids over a boolean flag (W6)
* ``gap_flags``       - "previous row within N ticks" flags via lag (W5)
* ``number_rows``     - exact 1..n numbering inside groups, skew-safe (W3, W8)
* ``rolling_prior_mean`` - mean of the previous N rows of an entity, skew-safe (W7)
* ``max_true_run``    - longest run of consecutive true flags per key (A6)

Windows over ticks work on per-session sequences whose length is bounded by the
tick domain, so a hash partitioning on the session key is the right physical
plan and it is shared by every step of a feature (one exchange). Incidents of a
session, entity-keyed and global sequences are not bounded (one key may hold a
third of all rows): ``number_rows`` range-partitions on the full sort key, so
Spark's sampler splits a hot group across many tasks, and the numbered rows are
then dealt into buckets of BUCKET_ROWS with a halo.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from playline.session import cut_lineage


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


# ---------------------------------------------------------------- W4 -------
def nearest_anchor(ticks: DataFrame, key: str = "match_id", tick: str = "timestamp_min",
                   value: str = "gold", target: int = 14, low: int = 12, high: int = 16,
                   out: str = "anchor_value", out_tick: str = "anchor_tick") -> DataFrame:
    """One row per key: ``value`` at the tick nearest ``target`` within [low, high].

    Ties (equal distance) go to the earlier tick. The (distance, tick) order
    is packed into one long, so the pick is ``min_by`` over fixed-width
    buffers: a hash aggregate with map-side combine, no sort of the sequence.
    """
    rank = (F.abs(F.col(tick) - F.lit(target)).cast("long") * F.lit(1 << 32)
            + (F.col(tick) - F.lit(low)).cast("long"))
    return (ticks.where(F.col(tick).between(low, high))
            .groupBy(key).agg(F.min_by(F.col(value), rank).alias(out), F.min(rank).alias("_r"))
            .select(key, out, (F.col("_r") % F.lit(1 << 32) + F.lit(low)).cast("int").alias(out_tick)))


BUCKET_ROWS = 4096


def _bucket(seq: str, rows: int):
    return F.floor((F.col(seq) - 1) / F.lit(rows)).cast("long")


def _with_halo(df: DataFrame, seq: str, rows: int, halo: int = 1) -> DataFrame:
    """Deal rows numbered 1, 2, ... per key into buckets of ``rows``; the last
    ``halo`` rows of a bucket also stand before the next one (``_own`` false)."""
    b = _bucket(seq, rows)
    own = F.struct(b.alias("b"), F.lit(True).alias("own"))
    copy = F.struct((b + 1).alias("b"), F.lit(False).alias("own"))
    last = ((F.col(seq) - 1) % rows) >= rows - halo
    x = df.withColumn("_x", F.explode(F.when(last, F.array(own, copy)).otherwise(F.array(own))))
    return x.withColumn("_bucket", F.col("_x.b")).withColumn("_own", F.col("_x.own")).drop("_x")


# ---------------------------------------------------------------- W6 -------
def bool_islands(df: DataFrame, key, order, flag: str, out: str = "block", seq: str | None = None,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Block id that increments whenever ``flag`` differs from the previous row.

    The first row of every key opens block 1 (it has no predecessor). With
    ``seq`` (rows numbered 1..n per key in this order) a long key is dealt into
    buckets: changes are counted inside buckets and carried over by a prefix
    sum of one row per bucket."""
    k = _cols(key)
    if seq is None:
        w = Window.partitionBy(*k).orderBy(*_cols(order))
        prev = F.lag(F.col(flag)).over(w)
        change = F.when(prev.isNull() | (prev != F.col(flag)), 1).otherwise(0)
        return df.withColumn(out, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*k, "_bucket").orderBy(seq)
    prev = F.lag(F.col(flag)).over(w)
    rows = (_with_halo(df, seq, bucket_rows).withColumn("_c", F.when(prev.isNull() | (prev != F.col(flag)), 1).otherwise(0))
            .where("_own")
            .withColumn("_local", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    before = Window.partitionBy(*k).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy(*k, "_bucket").agg(F.sum("_c").alias("_n"))
             .withColumn("_carry", F.sum("_n").over(before)).where(F.col("_carry").isNotNull()).drop("_n"))
    return (rows.join(carry, [*k, "_bucket"], "left")
            .select(*df.columns, (F.col("_local") + F.coalesce("_carry", F.lit(0))).alias(out)))


# ---------------------------------------------------------------- W5 -------
def gap_flags(df: DataFrame, key, order, value: str, max_gap: int, out: str = "within_gap",
              prev_out: str | None = None, seq: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``value - lag(value) <= max_gap``; the first row of a key is False.

    With ``seq`` (rows numbered 1..n per key in this order) a long key is dealt
    into buckets that know the row before them."""
    k = _cols(key)
    if seq is None:
        rows, w = df, Window.partitionBy(*k).orderBy(*_cols(order))
    else:
        rows, w = _with_halo(df, seq, bucket_rows), Window.partitionBy(*k, "_bucket").orderBy(seq)
    prev = F.lag(F.col(value)).over(w)
    res = rows.withColumn(out, F.coalesce((F.col(value) - prev) <= F.lit(max_gap), F.lit(False)))
    if prev_out:
        res = res.withColumn(prev_out, prev)
    return res if seq is None else res.where("_own").drop("_bucket", "_own")


# ---------------------------------------------------------------- J8 -------
def offset_lookup(df: DataFrame, key, tick: str, value: str, offset: int, out: str,
                  default=None) -> DataFrame:
    """``value`` of the same key at exactly ``tick + offset`` (else ``default``).

    For offset +-1 this is a guarded lag/lead (ticks are unique per key, so the
    row one tick away, when present, is the adjacent row): no self-join. Other
    offsets use an equi-join on (key, tick + offset)."""
    k = _cols(key)
    dflt = F.lit(default) if default is not None else F.lit(None).cast(df.schema[value].dataType)
    if abs(offset) == 1:
        w = Window.partitionBy(*k).orderBy(tick)
        nb_t = F.lag(tick).over(w) if offset == -1 else F.lead(tick).over(w)
        nb_v = F.lag(value).over(w) if offset == -1 else F.lead(value).over(w)
        return df.withColumn(out, F.when(nb_t == F.col(tick) + offset, nb_v).otherwise(dflt))
    other = df.select(*k, (F.col(tick) - offset).alias(tick), F.col(value).alias(out))
    j = df.join(other, k + [tick], "left")
    return j.withColumn(out, F.coalesce(F.col(out), dflt))


# ---------------------------------------------------------------- A6 -------
def run_by_bucket(df: DataFrame, key, seq: str, flag: str, extra=(), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per (key, bucket): aggregates ``extra`` and ``_run``, the longest run of
    true flags that ends in the bucket. ``seq`` numbers the rows 1..n per key;
    runs that enter a bucket are completed by a prefix maximum over one row per bucket."""
    k = _cols(key)
    w = Window.partitionBy(*k, "_bucket").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.col(flag), F.lit(False))
    last_off = F.max(F.when(~on, F.col(seq))).over(w)
    rows = df.withColumn("_bucket", _bucket(seq, bucket_rows)).withColumn("_off", last_off)
    parts = rows.groupBy(*k, "_bucket").agg(
        *extra, F.max("_off").alias("_last"),
        F.max(F.when(on & F.col("_off").isNotNull(), F.col(seq) - F.col("_off"))).alias("_inner"),
        F.max(F.when(on & F.col("_off").isNull(), F.col(seq))).alias("_lead"))
    before = Window.partitionBy(*k).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("_lead") - F.coalesce(F.max("_last").over(before), F.lit(0))
    return parts.withColumn("_run", F.greatest(F.col("_inner"), lead)).drop("_last", "_inner", "_lead")


def max_true_run(df: DataFrame, key, order, flag: str, out: str = "max_run", seq: str | None = None,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Longest run of consecutive True ``flag`` rows; keys without any True row are absent."""
    k = _cols(key)
    if seq is not None:
        runs = run_by_bucket(df, k, seq, flag, bucket_rows=bucket_rows)
        return (runs.groupBy(*k).agg(F.max("_run").cast("int").alias(out)).where(F.col(out).isNotNull()))
    blocks = bool_islands(df, k, order, flag, out="_blk")
    runs = blocks.where(F.col(flag)).groupBy(*k, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*k).agg(F.max("_n").cast("int").alias(out))


# ------------------------------------------------------------- W3 / W8 -----
def number_rows(df: DataFrame, group_cols, order_cols, out: str = "seq",
                num_partitions: int | None = None) -> DataFrame:
    """Exact 1..n numbering of rows inside each group by a total order, JVM only.

    The frame is range-partitioned on (group, order) - Spark samples the keys,
    so a hot group is split over many tasks - and checkpointed, so every later
    pass sees the same partitions even after executor loss. A row's global
    position is its place in its partition plus the rows before the partition;
    its number is that position less the first position of its group (one row
    per group). Rows with a NULL group form a group; no column leaves the JVM.
    ``order_cols`` must make the order total inside a group.
    """
    gcols, ocols = _cols(group_cols), _cols(order_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = gcols + ocols
    ranged = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id()))
    placed = _number_globally(ranged, df.columns, out)
    if not gcols:
        return placed
    # checkpointed, so that the join sees two plain inputs and can split a hot group
    first = cut_lineage(placed.groupBy(*gcols).agg(F.min(out).alias("_first"))
                        .withColumnsRenamed({c: f"_g_{c}" for c in gcols}))
    same = reduce(lambda a, b: a & b, [placed[c].eqNullSafe(first[f"_g_{c}"]) for c in gcols])
    return placed.join(first, same).select(*[placed[c] for c in df.columns],
                                           (F.col(out) - F.col("_first") + 1).alias(out))


def _number_globally(ranged: DataFrame, names, out: str) -> DataFrame:
    """Global 1..n numbering, JVM only: a row's position inside its
    (checkpointed, sorted) range partition is ``monotonically_increasing_id``
    minus the partition base; rows before the partition are a prefix sum over
    one count per partition (a table bounded by the partition count)."""
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.withColumn("_local", local).join(F.broadcast(before), "_pid")
            .select(*names, (F.col("_off") + F.col("_local") + 1).cast("long").alias(out)))


# ---------------------------------------------------------------- W7 -------
def rolling_prior_mean(df: DataFrame, entity, order_cols, value: str, n: int = 5,
                       neutral: float = 0.5, out: str = "prior_mean",
                       bucket_rows: int = 4096, seq_out: str | None = None) -> DataFrame:
    """Mean of ``value`` over the previous ``n`` rows of the same entity.

    Excludes the current row, uses however many prior rows exist (min 1),
    falls back to ``neutral`` with no history and clips to [0, 1].
    Skew-safe: rows are numbered per entity with ``number_rows``; each row is
    then placed in bucket ``seq // bucket_rows`` and the last ``n`` rows of a
    bucket are copied into the next bucket as halo, so the window runs on
    groups of at most ``bucket_rows + n`` rows however large one entity is.
    """
    ent = _cols(entity)
    both = _with_halo(number_rows(df, ent, order_cols, out="_seq"), "_seq", bucket_rows, n)
    w = (Window.partitionBy(*ent, "_bucket").orderBy("_seq").rowsBetween(-n, -1))
    mean = F.avg(F.col(value).cast("double")).over(w)
    res = (both.withColumn(out, F.least(F.greatest(F.coalesce(mean, F.lit(neutral)), F.lit(0.0)), F.lit(1.0)))
           .where("_own"))
    res = res.drop("_bucket", "_own")
    return res.withColumnRenamed("_seq", seq_out) if seq_out else res.drop("_seq")
