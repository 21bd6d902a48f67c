"""Cross-tokenizer alignment with pandas merge_asof.

Tokens of two vocabularies are laid over the same bytes (a space and the text).
For a batch of documents, ``merge_asof`` keyed by document finds for every token
start the token of the other side that covers it; the union of both directions
is every pair of overlapping tokens. Places where tokens of both sides end cut
the document into groups.

1. One pass encodes both sides once and writes each row's figures and ids, and
   beside them its task's counts of linked id pairs, combined before they are
   shuffled.
2. The corpus-wide counts are summed by pair; the highest of every B id is marked.
3. A second pass links the written ids again and adds up the counts of each row's
   links. The table of counts goes to the tasks in slices of about PAIRS pairs;
   a larger table takes more passes, each of which adds its share, so no
   broadcast grows beyond PAIRS and no pair is left out.

Defined cases: null and empty texts, and texts whose token bytes on either side
differ from a space and the text, have no tokens: zeros and an empty
groups_sha256; repeated rows count as often as they occur; rows with a null id
keep their rows; an empty table gives no rows; extra columns are ignored; whole
texts of any length.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.llm import bpe
from playline.llm.arrow import chunks, small_batches
from playline.llm.common import documents, stored

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIRS = 2_000_000        # pairs of a broadcast slice: 17 bytes each
HELD_PAIRS = 400_000     # distinct pairs that a task holds before it emits partial counts
CACHE_PARTS = 500_000    # parts of texts whose ids a task keeps at most (with 10 times as many ids)
CHUNK_TOKENS = 500_000


def piece_bytes(sp) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, <0xHH> the byte HH."""
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in range(sp.get_piece_size())]


class Sides:
    """Both tokenizers and the tables made from them, built once a task."""

    def __init__(self, a_tables: dict, b_model: bytes):
        import sentencepiece

        self.a = bpe.Encoder(a_tables | {"added": {}})  # strings of special tokens are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_raw, self.b_raw = a_tables["raw"], piece_bytes(self.b)
        # no token of A goes on beyond a space that follows another kind of character, and none of B does
        # unless a piece holds one: then parts of a text have the ids that they have in the text
        apart = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.cut = re.compile(r"(?<=\S) (?=.)", re.DOTALL).split if apart else (lambda t: [t])
        self._forget()
        self.a_len, self.b_len = (np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) for raw in (self.a_raw, self.b_raw))
        # decimal ids followed by a comma, or by what ends their side of a group
        self.shown = [b"%d%c" % (i, c) for n, end in ((len(self.a_raw), 124), (len(self.b_raw), 59)) for c in (44, end) for i in range(n)]

    def _forget(self) -> None:
        """Known parts of texts: their numbers, and for each side all their ids end to end with the first and the number of each."""
        empty = np.empty(0, dtype=np.int64)
        self.known, self.odd = {}, set()
        self.ids, self.first, self.n = [empty, empty], [empty, empty], [empty, empty]

    def _learn(self, parts: list[str]) -> None:
        a, b = self.a.encode([" " + p for p in parts]), self.b.encode(parts, num_threads=1)
        n = [np.fromiter(map(len, x), dtype=np.int64, count=len(parts)) for x in (a, b)]
        n[0] //= 4
        ids = [np.frombuffer(b"".join(a), dtype="<u4").astype(np.int64),
               np.fromiter(chain.from_iterable(b), dtype=np.int64, count=int(n[1].sum()))]
        want = [b" " + p.encode() for p in parts]
        size = np.fromiter(map(len, want), dtype=np.int64, count=len(parts))
        for side, length in enumerate((self.a_len, self.b_len)):
            begin = np.cumsum(n[side]) - n[side]
            end = np.concatenate([[0], np.cumsum(length[ids[side]])])
            if not (end[begin + n[side]] == np.cumsum(size)).all() or self._bytes(side, ids[side]) != b"".join(want):
                self.odd.update(p for p, w, i, k in zip(parts, want, begin.tolist(), n[side].tolist()) if self._bytes(side, ids[side][i:i + k]) != w)
            self.first[side] = np.concatenate([self.first[side], len(self.ids[side]) + begin])
            self.n[side] = np.concatenate([self.n[side], n[side]])
            self.ids[side] = np.concatenate([self.ids[side], ids[side]])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))

    def _bytes(self, side: int, ids: np.ndarray) -> bytes:
        return b"".join(map((self.a_raw, self.b_raw)[side].__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts end to end and the number of each text's; none for texts that a side does not reproduce."""
        if len(self.known) > CACHE_PARTS or len(self.ids[0]) > 10 * CACHE_PARTS:
            self._forget()
        cut = [self.cut(t) for t in texts]
        self._learn(list(set().union(*cut).difference(self.known)))
        keep = [bool(t) and (self.odd.isdisjoint(c) or self._same(t, c)) for t, c in zip(texts, cut)]
        sizes = np.array([len(c) if k else 0 for c, k in zip(cut, keep)], dtype=np.int64)
        parts = np.fromiter((self.known[p] for c, k in zip(cut, keep) if k for p in c), dtype=np.int64, count=int(sizes.sum()))
        edge = np.cumsum(sizes)
        return [self._laid(side, parts, edge) for side in (0, 1)]

    def _laid(self, side: int, parts: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[side][parts]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[side][np.repeat(self.first[side][parts] - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[edge], prepend=0)

    def _same(self, text: str, parts: list[str]) -> bool:
        """Whether both sides give the bytes of the whole text."""
        at = np.array([self.known[p] for p in parts])
        return all(self._bytes(side, self._laid(side, at, np.array([len(at)]))[0]) == (" " + text).encode() for side in (0, 1))


def links(a_doc: np.ndarray, a_at: np.ndarray, b_doc: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all overlapping tokens. ``*_at``: first bytes, rising over the batch.

    Where every document begins at one place on both sides, what stands last before a
    token is in its own document: the places are key enough. Else documents are the key."""
    a = pd.DataFrame({"at": a_at, "a": np.arange(len(a_at))})
    b = pd.DataFrame({"at": b_at, "b": np.arange(len(b_at))})
    a_first, b_first = (np.flatnonzero(np.diff(doc, prepend=-1)) for doc in (a_doc, b_doc))
    key = {}
    if not (np.array_equal(a_doc[a_first], b_doc[b_first]) and np.array_equal(a_at[a_first], b_at[b_first])
            and (np.diff(a_at) > 0).all() and (np.diff(b_at) > 0).all()):
        a["doc"], b["doc"], key = a_doc, b_doc, {"by": "doc"}
    down = pd.merge_asof(a, b, on="at", **key)
    up = pd.merge_asof(b, a, on="at", **key)
    i, j = up["a"].to_numpy(), up["b"].to_numpy()
    new = a_at[i] != b_at[j]  # tokens with one start are found both ways
    return np.concatenate([down["a"].to_numpy(), i[new]]), np.concatenate([down["b"].to_numpy(), j[new]])


def batch_links(sides, lengths) -> dict:
    """Tokens of a batch of documents end to end, and their links. ``sides``: (ids, number of each document's)."""
    out = {}
    for side, (ids, n), length in zip("ab", sides, lengths):
        end = np.cumsum(length[ids])
        out |= {side: ids, f"{side}_n": n, f"{side}_doc": np.repeat(np.arange(len(n)), n), f"{side}_end": end, f"{side}_at": end - length[ids]}
    i, j = links(out["a_doc"], out["a_at"], out["b_doc"], out["b_at"]) if len(out["a"]) else (out["a"], out["b"])
    return out | {"i": i, "j": j, "link_doc": out["a_doc"][i]}


def figures(x: dict, shown: list[bytes], n_a: int, n_b: int) -> tuple[np.ndarray, list[str]]:
    """(number of groups, digest of the groups) of every document."""
    docs = len(x["a_n"])
    if not len(x["a"]):
        return np.zeros(docs, dtype=np.int64), [""] * docs
    a_cut, b_cut = (x[f"{p}_end"] == x[f"{q}_end"][np.searchsorted(x[f"{q}_end"], x[f"{p}_end"])] for p, q in (("a", "b"), ("b", "a")))
    a_group, b_group = (np.cumsum(c) - c for c in (a_cut, b_cut))
    a_size, b_size = np.bincount(a_group), np.bincount(b_group)
    # place of every token when groups follow each other, A before B
    line = np.empty(len(x["a"]) + len(x["b"]), dtype=np.int64)
    line[np.arange(len(x["a"])) + (np.cumsum(b_size) - b_size)[a_group]] = x["a"] + a_cut * n_a
    line[np.arange(len(x["b"])) + np.cumsum(a_size)[b_group]] = x["b"] + b_cut * n_b + 2 * n_a
    edge = np.cumsum(x["a_n"] + x["b_n"])
    digests, begin = [], 0
    for end in edge.tolist():
        text = b"".join(map(shown.__getitem__, line[begin:end].tolist()))
        digests.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        begin = end
    return np.bincount(x["a_doc"][a_cut], minlength=docs), digests


def _kind(size: int) -> str:
    return "<u2" if size <= 65536 else "<u4"


def _small(ids: np.ndarray, n: np.ndarray, size: int) -> list[bytes]:
    """Ids of each document as little-endian integers."""
    return [x.tobytes() for x in np.split(ids.astype(_kind(size)), np.cumsum(n)[:-1])]


def _large(data: list[bytes], n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(data), dtype=_kind(size)).astype(np.int64), n


ROW = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids binary, b_ids binary"
PAIR = "a int, b int, n long"


def encoded(docs: DataFrame, a_tables: dict, b_model: bytes) -> DataFrame:
    """Rows of documents with their ids, and rows (a, b, n) with each task's counts of linked pairs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"{ROW.format(id=docs.schema['doc_id'].dataType.simpleString())}, {PAIR}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(docs.sparkSession)

    def run(batches):
        s = Sides(a_tables, b_model)
        codes, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def pairs():
            return pa.RecordBatch.from_arrays([pa.nulls(len(codes), f.type) for f in arrow][:8] + [
                pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], schema=arrow)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts):
                sides = s.encode(texts[i:j])
                x = batch_links(sides, (s.a_len, s.b_len))
                n_groups, digest = figures(x, s.shown, len(s.a_raw), len(s.b_raw))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(x["a_n"]), pa.array(x["b_n"]), pa.array(n_groups, pa.int64()),
                    pa.array(np.bincount(x["link_doc"], minlength=j - i), pa.int64()), pa.array(digest, pa.string()),
                    *(pa.array(_small(*side, len(raw)), pa.binary()) for side, raw in zip(sides, (s.a_raw, s.b_raw)))]
                    + [pa.nulls(j - i, f.type) for f in arrow][8:], schema=arrow)
                new, n = np.unique(x["a"][x["i"]] << 32 | x["b"][x["j"]], return_counts=True)
                codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
                if len(codes) > HELD_PAIRS:
                    yield pairs()
                    codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield pairs()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n, best): links of every id pair in the corpus, and whether no pair of its B id has more."""
    n = rows.filter("n IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    n = stored(n, "align-pairs")
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    code = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return stored(n.join(top, "b").select(code.alias("code"), "n", (F.col("n") == F.col("top")).alias("best")), "align-counts")


def _summed(rows: DataFrame, part: DataFrame, sizes: tuple[int, int], lengths) -> DataFrame:
    """Add to n_best and count_sum what the pairs of ``part`` give."""
    got = part.orderBy("code").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches):
        code, n, best = shared.value
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            n_a, n_b = cols["n_a"].to_numpy(), cols["n_b"].to_numpy()
            raw_a, raw_b = cols["a_ids"].to_pylist(), cols["b_ids"].to_pylist()
            best_sum, count_sum = [], []
            edge = np.flatnonzero(np.diff(np.cumsum(n_a + n_b) // CHUNK_TOKENS)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(n_a)]):
                x = batch_links((_large(raw_a[i:j], n_a[i:j], sizes[0]), _large(raw_b[i:j], n_b[i:j], sizes[1])), lengths)
                key = x["a"][x["i"]] << 32 | x["b"][x["j"]]
                at = np.minimum(np.searchsorted(code, key), len(code) - 1)
                hit = code[at] == key
                for value, out in ((best, best_sum), (n, count_sum)):
                    got = np.zeros(j - i, dtype=np.int64)
                    np.add.at(got, x["link_doc"], np.where(hit, value[at], 0))
                    out.append(got)
            for name, more in (("n_best", best_sum), ("count_sum", count_sum)):
                cols[name] = pa.compute.add(cols[name], pa.array(np.concatenate(more)))
            yield pa.RecordBatch.from_arrays([cols[c] for c in batch.schema.names], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def align(docs: DataFrame, a_path: str, b_path: str, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a_ids, b_ids) of every row;
    ids as little-endian integers, of 16 bits for vocabularies up to 65,536 entries, else 32."""
    import sentencepiece

    a_tables = bpe.load(a_path)
    with open(b_path, "rb") as f:
        b_model = f.read()
    b_raw = piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=b_model))
    lengths = tuple(np.fromiter(map(len, raw), dtype=np.int64) for raw in (a_tables["raw"], b_raw))
    every = stored(encoded(docs, a_tables, b_model), "align-rows", compression="zstd")
    counts = pair_counts(every)
    zero = F.lit(0).cast("long")
    rows = every.filter("n IS NULL").drop("a", "b", "n").withColumns({"n_best": zero, "count_sum": zero})
    slices = -(-counts.count() // pairs)
    for k in range(slices):
        # by hash, so that slices are about equal; a few more pairs than ``pairs`` do no harm
        part = counts.filter(F.pmod(F.xxhash64("code"), F.lit(slices)) == k)
        rows = _summed(rows, part, (len(a_tables["raw"]), len(b_raw)), lengths)
        if k < slices - 1:
            rows = stored(rows, "align-part", compression="zstd")
    return rows


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(documents(spark, sf_dir), bpe.tokenizer_path(A_FILE), bpe.tokenizer_path(B_FILE))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
