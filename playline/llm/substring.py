"""Substring dedup with a count-min prefilter.

A window is WINDOW consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller id.

1. Every task counts its windows in DEPTH hashed rows of cells; the compact
   partial counts are merged block by block into one count-min sketch. A cell
   counts at least what its windows count, so a window whose cells do not all
   reach 2 occurs once and is left out for good; none that repeats is lost.
2. What is kept of the sketch is one bit per cell (2 or more) and the list of hot
   cells (more than 1 / HOT_SHARE of all windows, or a quarter of a task's share, so
   at most that number a row). Its
   width follows the corpus up to MOST_CELLS_BITS; beyond that it lets more
   single windows through, which costs time and never changes the result.
3. Windows estimated repeated are grouped exactly by their 128-bit hash, which
   gives the least id of each. Hot windows never meet in one group: their
   least ids (a bounded number) are found with map-side minima and sent to the
   tasks.
4. The (id, window) pairs to remove return to their documents, which drop the words.

Windows are told apart by two independent 64-bit hashes; only inside one
document, where removals find their places again, one of them decides.

Defined cases: null or empty text has no words; fewer than WINDOW words make no
window; windows repeated inside one document only are kept; rows with the same
id don't remove each other's words; rows with a null id are neither compared nor
cut; equal rows are cut alike; an empty table gives no rows; extra columns are
ignored; whole texts of any length.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playline.llm.arrow import chunks, small_batches
from playline.llm.common import documents, stored
from playline.llm.words import mix, windows, word_hashes

WINDOW, DEPTH = 13, 2
MOST_CELLS_BITS, LEAST_CELLS_BITS, BLOCK_SHARE = 30, 16, 8   # cells a row; a row has 2 ** BLOCK_SHARE blocks
HOT_SHARE = 4096
FLUSH = 2_000_000       # windows that a task holds before it emits partial counts
BYTES_PER_WORD = 6


def window_hashes(texts: list[bytes], width: int = WINDOW, halves: int = 1):
    """(number of words of each text, hashes of all windows, text number and first word of each window);
    with two halves the hashes are a pair of arrays."""
    a, n = word_hashes(texts)
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(texts)), n)[:max(0, a.shape[1] - width + 1)]
    inside = np.arange(len(doc)) + width <= (begin + n)[doc]
    doc = doc[inside]
    h = [windows(a[k], width, k)[inside] for k in range(halves)]
    return n, h[0] if halves == 1 else h, doc, np.flatnonzero(inside) - begin[doc]


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h ^ np.uint64(0x5851F42D4C957F2D * d & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.uint32)
            for d in range(1, DEPTH + 1)]


def pack(offsets: np.ndarray) -> bytes:
    """Strictly rising offsets as gaps of one byte; 255 stands for 255 more."""
    gap = np.diff(offsets.astype(np.int64), prepend=-1) - 1
    size = gap // 255 + 1
    out = np.full(int(size.sum()), 255, dtype=np.uint8)
    out[np.cumsum(size) - 1] = gap % 255
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    ends = np.flatnonzero(b != 255)
    return np.cumsum(b)[ends] + np.arange(len(ends))


def _slices(batches):
    """(ids, texts as bytes) of about CHUNK_CHARS bytes; rows with a null id left out."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        keep = [k for k, i in enumerate(ids) if i is not None]
        if len(keep) < len(ids):
            ids, texts = [ids[k] for k in keep], [texts[k] for k in keep]
        for i, j in chunks(texts):
            yield np.array(ids[i:j], dtype=np.int64), texts[i:j]


def _binary(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def sketch(docs: DataFrame, bits: int) -> DataFrame:
    """Partial counts of every task: (row, block, packed cells, counts above one)."""
    block_bits = bits - BLOCK_SHARE

    def count(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        n = 0

        def emit():
            for d in range(DEPTH):
                cells, c = np.unique(np.concatenate(held[d]), return_counts=True)
                held[d].clear()
                edge = np.searchsorted(cells, np.arange((1 << BLOCK_SHARE) + 1, dtype=np.uint64) << np.uint64(block_bits))
                rows = [(k, i, j) for k, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if j > i]
                low = (cells & np.uint32((1 << block_bits) - 1)).astype(np.uint32)
                more = []
                for _, i, j in rows:
                    at = np.flatnonzero(c[i:j] > 1)
                    more.append(np.stack([low[i:j][at], np.minimum(c[i:j][at], 2 ** 32 - 1)]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(rows), pa.int32()), pa.array([k for k, _, _ in rows], pa.int32()),
                     pa.array([pack(low[i:j]) for _, i, j in rows], pa.binary()), pa.array(more, pa.binary())],
                    names=["row", "block", "cells", "more"])

        for _, texts in _slices(batches):
            h = window_hashes(texts)[1]
            if len(h):
                for d, c in enumerate(_cells(h, bits)):
                    held[d].append(c)
                n += len(h)
            if n >= FLUSH:
                yield from emit()
                n = 0
        if n:
            yield from emit()

    return docs.mapInArrow(count, "row int, block int, cells binary, more binary")


def merged(parts: DataFrame, bits: int, hot: int, tasks: int) -> DataFrame:
    """One row per block: bit map of cells counted twice or more, and the cells counted ``hot`` times or more."""
    size = 1 << (bits - BLOCK_SHARE)

    def merge(batches):
        at, counts = None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                 pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary()),
                 pa.array([np.flatnonzero(counts >= hot).astype("<u4").tobytes()], pa.binary())],
                names=["row", "block", "twice", "hot"])

        for b in batches:
            for r, k, cells, more in zip(*(b.column(i).to_pylist() for i in range(4))):
                if at != (r, k):
                    if at is not None:
                        yield out()
                    at, counts = (r, k), np.zeros(size, dtype=np.uint32)
                counts[unpack(cells)] += np.uint32(1)
                if more:
                    cell, c = np.frombuffer(more, dtype="<u4").reshape(2, -1)
                    counts[cell] += c - np.uint32(1)
        if at is not None:
            yield out()

    return (parts.repartition(tasks, "row", "block").sortWithinPartitions("row", "block")
            .mapInArrow(merge, "row int, block int, twice binary, hot binary"))


class Estimate:
    """The merged sketch as tasks use it."""

    def __init__(self, bits: int, twice: list[bytes], hot: list[np.ndarray]):
        self.bits, self.twice, self.hot = bits, twice, hot

    def parts(self) -> tuple:
        """Plain values for a broadcast."""
        return self.bits, self.twice, self.hot

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Windows that may occur twice."""
        ok = np.ones(len(h), dtype=bool)
        for t, c in zip(self.twice, _cells(h, self.bits)):
            ok &= (np.frombuffer(t, dtype=np.uint8)[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return ok

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), dtype=bool)
        for known, c in zip(self.hot, _cells(h, self.bits)):
            ok &= np.isin(c, known)
        return ok


def estimate(docs: DataFrame, max_bits: int = MOST_CELLS_BITS) -> Estimate | None:
    """Pass 1. The driver holds one bit per cell: at most DEPTH * 2 ** max_bits / 8 bytes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    windows = max(1, size // BYTES_PER_WORD)
    bits = max(LEAST_CELLS_BITS, min(max_bits, math.ceil(math.log2(1.5 * windows))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = stored(merged(sketch(docs, bits), bits, max(64, windows // max(HOT_SHARE, 4 * tasks)), tasks), "sketch")
    twice = [bytearray((1 << bits) // 8) for _ in range(DEPTH)]
    hot: list[list[np.ndarray]] = [[np.empty(0, dtype=np.uint32)] for _ in range(DEPTH)]
    step = (1 << (bits - BLOCK_SHARE)) // 8
    some = False
    for r in done.toLocalIterator():
        some = True
        twice[r["row"]][r["block"] * step:(r["block"] + 1) * step] = r["twice"]
        hot[r["row"]].append(np.frombuffer(r["hot"], dtype="<u4") + np.uint32(r["block"] << (bits - BLOCK_SHARE)))
    return Estimate(bits, [bytes(t) for t in twice], [np.concatenate(x) for x in hot]) if some else None


def _firsts(h: np.ndarray, g: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes (h, g) in order, and the least id of each."""
    o = np.lexsort((i, g, h))
    h, g, i = h[o], g[o], i[o]
    f = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][:len(h)]
    return h[f], g[f], i[f]


def hot_firsts(docs: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the hot windows, in order, and the least id of each (a bounded number)."""
    def least(batches):
        est = Estimate(*shared.value)
        held = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for own, texts in _slices(batches):
            _, (h, g), doc, _ = window_hashes(texts, halves=2)
            at = np.flatnonzero(est.is_hot(h))
            if len(at):
                held = _firsts(*(np.concatenate(x) for x in zip(held, (h[at], g[at], own[doc[at]]))))
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].view(np.int64)), pa.array(held[2])],
                                         names=["h", "g", "first"])

    rows = (docs.mapInArrow(least, "h long, g long, first long").groupBy("h", "g").agg(F.min("first").alias("first"))).collect()
    h, g, first = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    return _firsts(h.view(np.uint64), g.view(np.uint64), first)


def repeats(docs: DataFrame, max_bits: int = MOST_CELLS_BITS) -> DataFrame:
    """(doc_id, h): windows that also start in a document with a smaller id. ``docs``: (doc_id, text binary)."""
    spark = docs.sparkSession
    est = estimate(docs, max_bits)
    if est is None:
        return spark.createDataFrame([], "doc_id long, h long")
    shared = spark.sparkContext.broadcast(est.parts())
    hot_h, hot_g, hot_first = hot_firsts(docs, shared) if all(len(x) for x in est.hot) else (np.empty(0, np.uint64),) * 3

    def emit(batches):
        e = Estimate(*shared.value)
        for own, texts in _slices(batches):
            _, (h, g), doc, _ = window_hashes(texts, halves=2)
            at = np.flatnonzero(e.repeated(h))
            if not len(at):
                continue
            h, g, i = h[at], g[at], own[doc[at]]
            o = np.lexsort((g, h, i))  # a window counts once a document
            h, g, i = h[o], g[o], i[o]
            f = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
            h, g, i = h[f], g[f], i[f]
            spot = np.minimum(np.searchsorted(hot_h, h), max(len(hot_h) - 1, 0))
            hot = (hot_h[spot] == h) & (hot_g[spot] == g) if len(hot_h) else np.zeros(len(h), dtype=bool)
            # a hot window is settled here; a lane by document keeps its rows from meeting
            keep = ~hot | (i > hot_first[spot] if len(hot_h) else False)
            lane = np.where(hot, 1 + (mix(i.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(g[keep].view(np.int64)), pa.array(i[keep]),
                                              pa.array(lane[keep].astype(np.int32))], names=["h", "g", "doc_id", "lane"])

    rows = docs.mapInArrow(emit, "h long, g long, doc_id long, lane int")
    first = F.min("doc_id").over(Window.partitionBy("h", "g", "lane"))
    return (rows.withColumn("first", first).filter((F.col("lane") > 0) | (F.col("doc_id") > F.col("first")))
            .select("doc_id", "h"))


def cut(docs: DataFrame, max_bits: int = MOST_CELLS_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with the words that stay, joined by one space."""
    d = _binary(docs)
    gone = repeats(d, max_bits).groupBy("doc_id").agg(F.collect_list("h").alias("gone"))

    def rewrite(batches):
        for b in batches:
            ids, texts, gones = b.column(0), b.column(1).to_pylist(), b.column(2)
            has = gones.is_valid().to_numpy(zero_copy_only=False)
            for i, j in chunks(texts):
                words = [t.split() for t in texts[i:j]]  # exactly the six ASCII white-space bytes
                n, removed = list(map(len, words)), [0] * (j - i)
                some = np.flatnonzero(has[i:j])  # other texts keep every word
                if len(some):
                    _, h, doc, at = window_hashes([texts[i + k] for k in some])
                    edge = np.searchsorted(doc, np.arange(len(some) + 1))
                    for x, k in enumerate(some.tolist()):
                        known = gones[i + k].values.to_numpy().view(np.uint64)
                        hit = at[edge[x]:edge[x + 1]][np.isin(h[edge[x]:edge[x + 1]], known)]
                        step = np.zeros(n[k] + 1, dtype=np.int64)
                        np.add.at(step, hit, 1)
                        np.add.at(step, hit + WINDOW, -1)
                        stay = np.cumsum(step)[:-1] == 0
                        removed[k] = n[k] - int(stay.sum())
                        words[k] = [w for w, s in zip(words[k], stay.tolist()) if s]
                kept = [b" ".join(ws) for ws in words]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    return (d.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(rewrite, schema)
            .withColumn("kept", F.col("kept").cast("string")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d
    WHERE len(ws) >= {WINDOW} AND doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM w JOIN f USING (g) WHERE doc_id > first)),
r AS (SELECT rid, list(p) AS ps, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
    list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)"""
