"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Documents with equal sets are one
node: a set is named by two 64-bit digests over two independent hashes of its
shingles, both must agree, and nodes whose first names clash get others.
Similarities are counted on 64-bit hashes of shingles. Nodes that share a band of MinHash values are compared value
by value: after every step the posterior probability that the similarity
reaches THRESHOLD (uniform prior) is looked up from the matches so far, and the
pair is dropped below TOLERANCE. What survives joins candidate groups; inside a
group all pairs of sets are compared exactly.

Nothing lists the pairs of a group: bands emit a star per group of surviving
pairs, the exact step emits link counts and a star per linked group. Bands and
groups above BLOCK nodes are dealt out as pairs of blocks, so all their pairs
are still compared, by many tasks. A pair at the threshold shares no band with
probability (1 - THRESHOLD ** ROWS) ** BANDS, about 1e-7.

Defined cases: null and empty texts have the empty set and are equal to each
other only; a text of fewer than five words is one shingle; equal sets are
linked; repeated rows are documents of their own; rows with a null id come
first in the order of ids; an empty table gives no rows; extra columns are ignored
by ``classes`` and kept by ``deduplicate``; whole texts of any length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.llm.arrow import chunks, small_batches
from playline.llm.common import documents, stored
from playline.llm.components import components
from playline.llm.words import FACTORS, few, mix, windows, word_hashes

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, BLOCK = 40, 5, 512
STEPS = (16, 32, 64, 128, BANDS * ROWS)
NO_ID = -(1 << 63)  # stands for a null id

_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE, half: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text (one half of 128 bits)."""
    return _sets(*word_hashes(texts), size, half)


def _sets(words: np.ndarray, n: np.ndarray, size: int, half: int) -> list[np.ndarray]:
    a = words[half]
    h = windows(a, size, half)
    out, at = [], 0
    for c in n.tolist():
        if c >= size:
            out.append(np.unique(h[at:at + c - size + 1]))
        elif c:
            out.append(few(a[at:at + c], half))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def named_sets(texts: list[bytes]) -> list[tuple[np.ndarray, tuple[int, int]]]:
    """(shingle set, both names of it) of every text."""
    import xxhash

    words, n = word_hashes(texts)
    name = lambda s: xxhash.xxh64_intdigest(s.tobytes(), 5) - (1 << 63)
    return [(a, (name(a), name(b))) for a, b in zip(_sets(words, n, SHINGLE, 0), _sets(words, n, SHINGLE, 1))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 [sets, BANDS * ROWS] MinHash values (low halves of 32 bits); empty sets get 0."""
    out = np.zeros((len(sets), BANDS * ROWS), dtype=np.uint16)
    some = [k for k, s in enumerate(sets) if len(s)]
    i = 0
    while i < len(some):  # about 64k shingles at a time, whole sets
        j, size = i, 0
        while j < len(some) and (j == i or size + len(sets[some[j]]) <= 65536):
            size += len(sets[some[j]])
            j += 1
        part = some[i:j]
        h = (np.concatenate([sets[k] for k in part]) >> np.uint64(32)).astype(np.uint32)
        first = np.r_[0, np.cumsum([len(sets[k]) for k in part])[:-1]]
        for c in range(BANDS * ROWS):
            x = (h ^ _XOR[c]) * _MUL[c]
            x ^= x >> np.uint32(15)
            out[part, c] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), first).astype(np.uint16)
        i = j
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, steps=STEPS) -> list[int]:
    """Fewest matches after each step that keep P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior that probability is P(Bin(n + 1, threshold) <= matches)."""
    out = []
    for n in steps:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return out


def survivors(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray | None,
              need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that pass every step; within ``left``, or between left and right."""
    a, b = (left, left) if right is None else (left, right)
    hits = np.zeros((len(a), len(b)), dtype=np.int16)
    for c in range(STEPS[0]):
        hits += sig[a, c][:, None] == sig[b, c][None, :]
    ok = hits >= need[0]
    s, t = size[a].astype(np.float64)[:, None], size[b].astype(np.float64)[None, :]
    ok &= np.minimum(s, t) >= THRESHOLD * np.maximum(s, t)
    if right is None:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    m = hits[i, j].astype(np.int64)
    i, j = a[i], b[j]
    for k in range(1, len(STEPS)):
        lo, hi = STEPS[k - 1], STEPS[k]
        keep = np.empty(len(i), dtype=bool)
        for x in range(0, len(i), 65536):
            y = slice(x, x + 65536)
            m[y] += (sig[i[y], lo:hi] == sig[j[y], lo:hi]).sum(1)
            keep[y] = m[y] >= need[k]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index of the component of each of n items under pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            break
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _groups(batches, keys: int):
    """Lists of rows with equal first ``keys`` columns, from sorted batches."""
    held, now = [], None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != now:
                if held:
                    yield now, held
                held, now = [], r[:keys]
            held.append(r[keys:])
    if held:
        yield now, held


def _dealt(df: DataFrame, size: str, node: str = "node") -> DataFrame:
    """Append p, q: the pairs of blocks that a row of a group of ``size`` rows takes part in (0, 0 when small)."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), node), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        F.least(own, k).alias("p"), F.greatest(own, k).alias("q"), own.alias("own")))
    return df.withColumn("_x", F.explode(pairs)).select(*df.columns, "_x.p", "_x.q", "_x.own")


def _sized(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of groups with two rows or more, with the group's size."""
    sizes = stored(df.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1"), name)
    return df.join(sizes, key)


def describe(docs: DataFrame) -> DataFrame:
    """(id, name, twin, n, sig) of every row."""
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in chunks(texts):
                sets, names = zip(*named_sets(texts[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *(pa.array(x, pa.int64()) for x in zip(*names)),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())],
                    names=["id", "name", "twin", "n", "sig"])

    return _plain(docs).mapInArrow(run, "id long, name long, twin long, n long, sig binary")


def _plain(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(len(ids), -1).astype(np.uint64)
            for k in range(BANDS):
                h = np.full(len(ids), k + 1, dtype=np.uint64)
                for c in range(k * ROWS, (k + 1) * ROWS):
                    h = mix(h * FACTORS[0] + sig[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], names=["band", "node"])

    return nodes.filter("n > 0").select("node", "sig").mapInArrow(run, "band long, node long")


def candidate_groups(nodes: DataFrame, tasks: int) -> DataFrame:
    """(node, root) of the nodes that a surviving pair connects."""
    members = _dealt(_sized(_bands(nodes), "band", "jaccard-bands"), "size")
    rows = (members.join(nodes.select("node", "n", "sig"), "node")
            .select("band", "p", "q", "own", "node", "n", "sig"))
    need = least_matches()

    def run(batches):
        for (_, p, q), rs in _groups(batches, 3):
            own = np.array([r[0] for r in rs])
            name = np.array([r[1] for r in rs], dtype=np.int64)
            size = np.array([r[2] for r in rs], dtype=np.int64)
            sig = np.frombuffer(b"".join([r[3] for r in rs]), dtype=np.uint16).reshape(len(rs), -1)
            left, right = (np.arange(len(rs)), None) if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
            i, j = survivors(sig, size, left, right, need)
            if len(i):
                root = stars(i, j, len(rs))
                at = np.flatnonzero(root != np.arange(len(rs)))
                yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(name[root[at]])], names=["u", "v"])

    edges = (rows.repartition(tasks, "band", "p", "q").sortWithinPartitions("band", "p", "q")
             .mapInArrow(run, "u long, v long"))
    return components(edges)


def links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, tasks: int) -> DataFrame:
    """Exact step: (node, texts, docs, to) partial link counts and star edges of every candidate group."""
    member = _sized(groups, "root", "jaccard-groups").join(nodes.select("node", "name", "twin", "rep", "copies"), "node")
    places = _dealt(member, "size").groupBy("rep", "node", "name", "twin", "copies", "root").agg(
        F.collect_list(F.struct("p", "q", "own")).alias("places"))

    def sets(batches):
        # a row of documents is the named node if its set has both names (ids may repeat)
        for b in batches:
            node, copies, root, places, name, twin, texts = (c.to_pylist() for c in b.columns)
            for i, j in chunks(texts):
                for k, (s, names) in zip(range(i, j), named_sets(texts[i:j])):
                    if names != (name[k], twin[k]):
                        continue
                    ps = places[k]
                    yield pa.RecordBatch.from_pydict({
                        "root": [root[k]] * len(ps), "p": pa.array([x["p"] for x in ps], pa.int32()),
                        "q": pa.array([x["q"] for x in ps], pa.int32()), "own": pa.array([x["own"] for x in ps], pa.int32()),
                        "node": [node[k]] * len(ps), "copies": [copies[k]] * len(ps),
                        "hashes": pa.array([s.tobytes()] * len(ps), pa.binary())})

    schema = "root long, p int, q int, own int, node long, copies long, hashes binary"
    found = (_plain(docs).join(stored(places, "jaccard-places").withColumnRenamed("rep", "id").hint("merge"), "id")
             .select("node", "copies", "root", "places", "name", "twin", "text").mapInArrow(sets, schema))

    need = least_matches()

    def verify(batches):
        for (_, p, q), rs in _groups(batches, 3):
            once = {r[1]: r for r in rs}
            rs = [once[k] for k in sorted(once)]
            own = np.array([r[0] for r in rs])
            name, copies = (np.array([r[k] for r in rs], dtype=np.int64) for k in (1, 2))
            left, right = (np.arange(len(rs)), None) if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
            i, j = exact_pairs([np.frombuffer(r[3], dtype=np.uint64) for r in rs], left, right, need)
            if not len(i):
                continue
            texts = np.bincount(i, minlength=len(rs)) + np.bincount(j, minlength=len(rs))
            held = (np.bincount(i, copies[j], len(rs)) + np.bincount(j, copies[i], len(rs))).astype(np.int64)
            root = stars(i, j, len(rs))
            at = np.flatnonzero(texts)
            yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(texts[at].astype(np.int64)), pa.array(held[at]),
                                              pa.array(name[root[at]])], names=["node", "texts", "docs", "to"])

    return (found.repartition(tasks, "root", "p", "q").sortWithinPartitions("root", "p", "q")
            .mapInArrow(verify, "node long, texts long, docs long, to long"))


def exact_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, need: list[int],
                threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose exact Jaccard similarity reaches the threshold, among those that
    pruning keeps; within left, or between left and right."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    i, j = survivors(signatures(sets), size, left, right, need)
    if not len(i):
        return i, j
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    common = np.empty(len(i), dtype=np.int64)
    edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True])
    mark = np.zeros(len(value), dtype=bool)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        own = code[begin[i[a]]:begin[i[a]] + size[i[a]]]
        mark[own] = True
        for x in range(a, b, 1024):  # partners of one set, their codes laid end to end
            js = j[x:min(b, x + 1024)]
            n = size[js]
            first = np.cumsum(n) - n
            flat = np.repeat(begin[js] - first, n) + np.arange(n.sum())
            common[x:x + len(js)] = np.add.reduceat(mark[code[flat]].astype(np.int64), first)
        mark[own] = False
    ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[ok], j[ok]


def nodes_of(described: DataFrame, attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Described rows with their node, and one row per node. A node is the first
    name of its set; where sets with different second names share it, another number made of both."""
    described = described.withColumn("node", F.col("name"))
    for k in range(attempts):
        nodes = stored(described.groupBy("node").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"),
            F.first("name").alias("name"), F.min("twin").alias("twin"), (F.min("twin") != F.max("twin")).alias("clash"),
            (F.min("name") != F.max("name")).alias("met")), "jaccard-nodes")
        clash = nodes.filter("clash OR met").select("node", F.lit(True).alias("again"))
        if clash.isEmpty():
            return described, nodes.drop("clash", "met")
        described = stored(described.join(clash, "node", "left").withColumn("node", F.when(
            F.col("again"), F.xxhash64(F.lit(k), "name", "twin")).otherwise(F.col("node"))).drop("again"), "jaccard-rows")
    raise RuntimeError("names of shingle sets clash again and again")


def classes(docs: DataFrame) -> DataFrame:
    """(id, name, twin, node, class_id, copy_id, n_links, n_text_links, root) of every row.

    class_id: least id of the rows connected by links; copy_id: least id with an
    equal set; n_links: other rows at the threshold or above, equal sets
    included; n_text_links: other sets at the threshold or above."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described, nodes = nodes_of(stored(describe(docs), "jaccard-rows"))
    found = stored(links(docs, nodes, candidate_groups(nodes, tasks), tasks), "jaccard-links")
    count = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    known = nodes.select("node", "rep", "copies").join(count, "node", "left").join(roots, "node", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "node")), "jaccard-known")
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    table = stored(known.join(least, "root").select(
        "node", "class_id", F.col("rep").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), "root"), "jaccard-table")
    return described.select("id", "name", "twin", "node").join(table, "node")


def _shown(c: str):
    return F.when(F.col(c) != NO_ID, F.col(c)).alias("doc_id" if c == "id" else c)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(documents(spark, sf_dir))
    return out.select(_shown("id"), _shown("class_id"), _shown("copy_id"), "n_links", "n_text_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class: the least id (of equal ids the least node), with its own columns."""
    pick = (classes(docs).groupBy("root").agg(F.min(F.struct("id", "node", "name", "twin")).alias("x"))
            .select(F.col("x.id").alias("_id"), F.col("x.name").alias("_name"), F.col("x.twin").alias("_twin")))
    pick = stored(pick, "jaccard-kept")
    d = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    # rows that share the kept id: only those whose text has the kept set, and one of them
    some = d.join(pick, "_id").select("_doc", "_id", "_name", "_twin", "_text")

    def same(batches):
        for b in batches:
            names, texts = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist())), b.column(4).to_pylist()
            keep = []
            for i, j in chunks(texts):
                keep += [own == want for (_, own), want in zip(named_sets(texts[i:j]), names[i:j])]
            yield b.filter(pa.array(keep, pa.bool_()))

    return some.mapInArrow(same, some.schema).dropDuplicates(["_id", "_name", "_twin"]).select("_doc.*")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}),
    lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))) END AS sh FROM d),
k AS (SELECT rid, doc_id, sh, md5(array_to_string(sh, chr(10))) AS node FROM s),
n AS MATERIALIZED (SELECT node, min(doc_id) AS rep, count(*) AS copies, any_value(sh) AS sh FROM k GROUP BY node),
x AS MATERIALIZED (SELECT node, len(sh) AS size, unnest(sh) AS g FROM n),
pair AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM x a JOIN x b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING count(*) >= {THRESHOLD} * (a.size + b.size - count(*)) - 1e-9),
reach AS (SELECT node AS u, node AS v FROM n UNION SELECT r.u, p.v FROM reach r JOIN pair p ON r.v = p.u),
cls AS (SELECT r.u AS node, min(n.rep) AS class_id FROM reach r JOIN n ON n.node = r.v GROUP BY r.u),
deg AS (SELECT p.u AS node, count(*) AS t, sum(n.copies) AS c FROM pair p JOIN n ON n.node = p.v GROUP BY p.u)
SELECT k.doc_id, cls.class_id, n.rep AS copy_id, (n.copies - 1 + coalesce(deg.c, 0))::BIGINT AS n_links,
  coalesce(deg.t, 0)::BIGINT AS n_text_links
FROM k JOIN n USING (node) JOIN cls USING (node) LEFT JOIN deg USING (node)"""
