"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its words, weight = number of occurrences. For
sample k and term t, hashes of (t, k) give r, c ~ Gamma(2, 1) and b ~ U(0, 1);
with s = floor(ln(w) / r + b), the sample is the (term, s) of least
ln c - r (s - b) - r. Two documents share sample k with probability equal to
their generalised Jaccard similarity sum(min) / sum(max), so the share of equal
samples estimates it. A sample is kept as the 32-bit pattern of its least value,
which depends on (term, s, k) only.

``near_next`` and the edited text need the following document in id order:
documents are dealt into id ranges, each range also gets the first documents of
the next one, and every task walks its ranges in order. Texts move once; what
reaches the driver is one bound and one first id per range.

Defined cases: null or empty text (no words) has the all-empty fingerprint,
equal to itself; rows with equal ids follow each other by text, null ids come
first; the last row's next is the first row (itself if it is alone); an
empty table gives no rows; extra columns are ignored; whole texts of any length.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.llm.arrow import CHUNK_CHARS, small_batches
from playline.llm.common import documents

SAMPLES = 128  # standard error sqrt(J (1 - J) / SAMPLES): 0.044 at most, 0.035 at 0.8
RANGES_PER_TASK = 8
LOWEST = -(1 << 63)  # the place of a null id in the order


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        import xxhash

        self.k = samples
        self.hash = xxhash.xxh64_intdigest
        self.salt = _mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _uniforms(self, h: np.ndarray, which: int) -> list[np.ndarray]:
        """Three independent U(0, 1) of 21 bits for each (term, sample)."""
        x = _mix(h[:, None] ^ self.salt[None, which * self.k:(which + 1) * self.k])
        bits = [x >> np.uint64(43), (x >> np.uint64(22)) & np.uint64(0x1FFFFF), x & np.uint64(0x1FFFFF)]
        return [(b.astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -21) for b in bits]

    def values(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """ln a of (term hash, weight) rows: float32 [rows, samples]."""
        out = np.empty((len(h), self.k), dtype=np.float32)
        for i in range(0, len(h), 1024):
            hh, lw = h[i:i + 1024], np.log(w[i:i + 1024].astype(np.float32))[:, None]
            u, v, b = self._uniforms(hh, 0)
            r = -np.log(u * v)
            u, v, _ = self._uniforms(hh, 1)
            s = np.floor(lw / r + b)
            out[i:i + 1024] = np.log(-np.log(u * v)) - r * (s - b) - r
        return out

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """uint16 [texts, samples]; rows of texts without words are 0."""
        sig = np.zeros((len(texts), self.k), dtype=np.uint16)
        words = [t.split() for t in texts]  # exactly the six ASCII white-space bytes
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not n.sum():
            return sig
        coded = pa.array([w for ws in words for w in ws], type=pa.large_binary()).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        hashes = np.fromiter(map(self.hash, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
        pair, weight = np.unique(np.repeat(np.arange(len(texts)), n) * len(hashes) + code, return_counts=True)
        doc, term = np.divmod(pair, len(hashes))
        # equal (term, weight) rows of the slice share one computation
        top = int(weight.max()) + 1
        tw, at = np.unique(term * top + weight, return_inverse=True)
        t, w = np.divmod(tw, top)
        vals = self.values(hashes[t], w)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ends = np.r_[first[1:], len(doc)]
        i = 0
        while i < len(first):  # whole documents, about 8192 terms at a time
            j = max(i + 1, int(np.searchsorted(ends, first[i] + 8192, side="right")))
            least = np.minimum.reduceat(vals[at[first[i]:ends[j - 1]]], first[i:j] - first[i], axis=0)
            sig[doc[first[i:j]]] = (_mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
            i = j
        return sig


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many characters of the following text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, tasks: int) -> DataFrame:
    """Rows (range, place, doc_id, text, own), sorted within tasks by range, own first, id, text.

    Every range ends with the first rows of the following range (own = false;
    the first range follows the last)."""
    small_batches(docs.sparkSession)
    ranges = tasks * RANGES_PER_TASK
    d = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).cast("long").alias("place"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce("text", F.lit("")).alias("text"))
    ids = d.select("place")
    found = ids.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)

    def least(batches):
        best: dict[int, int] = {}
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for r, v in zip(*_group_min(np.searchsorted(bounds, x, side="right"), x)):
                best[r] = min(v, best.get(r, v))
        yield pa.RecordBatch.from_pydict({"range": pa.array(list(best), pa.int32()),
                                          "place": pa.array(list(best.values()), pa.int64())})

    heads = dict(ids.mapInArrow(least, "range int, place long").groupBy("range").agg(F.min("place")).collect())
    order = sorted(heads)
    before = {heads[r]: order[k - 1] for k, r in enumerate(order)}  # first id of a range -> the range before it
    first = np.array(sorted(before), dtype=np.int64)

    def deal(batches):
        for b in batches:
            place = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, place, side="right").astype(np.int32)), *b.columns,
                 pa.array(np.ones(len(place), dtype=bool))], names=["range", "place", "doc_id", "text", "own"])
            at = np.flatnonzero(np.isin(place, first))
            if len(at):
                t = b.take(pa.array(at))
                to = np.array([before[x] for x in place[at].tolist()], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), *t.columns, pa.array(np.zeros(len(at), dtype=bool))],
                                                 names=["range", "place", "doc_id", "text", "own"])

    schema = "range int, place long, doc_id long, text string, own boolean"
    return (d.mapInArrow(deal, schema).repartition(tasks, "range")
            .sortWithinPartitions("range", F.desc("own"), "place", "text"))


def _group_min(key: np.ndarray, x: np.ndarray):
    if not len(key):
        return [], []
    o = np.lexsort((x, key))
    k = key[o]
    f = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[f].tolist(), x[o][f].tolist()


OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _walk(batches, samples: int):
    """Own rows with their following row, in slices of about CHUNK_CHARS characters."""
    sampler = Sampler(samples)
    rows: list[tuple] = []
    size = 0

    def flush(rows):
        texts = [r[2] for r in rows]
        own = [i for i in range(len(rows) - 1) if rows[i][3]]
        new = [edited(texts[i], texts[i + 1]) for i in own]
        sig = sampler.signatures([t.encode() for t in texts + new])
        a, b = sig[:len(rows)], sig[len(rows):]
        code = lambda x: base64.b64encode(x.astype("<u2").tobytes()).decode()
        at = np.array(own, dtype=np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
            pa.array([code(a[i]) for i in own], pa.string()), pa.array([code(x) for x in b], pa.string()),
            pa.array(likeness(a[at], b) if own else [], pa.float64()),
            pa.array(likeness(a[at], a[at + 1]) if own else [], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for b in batches:
        for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            if rows and rows[-1][0] == r[0] and not rows[-1][3]:
                continue  # further first rows of the next range
            rows.append(r)
            size += len(r[2])
            if size > CHUNK_CHARS:
                yield flush(rows)
                rows, size = rows[-1:], len(r[2])
    if rows:
        yield flush(rows)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, tasks).mapInArrow(lambda it: _walk(it, samples), OUT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
