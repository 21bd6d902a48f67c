"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words
is one window. Every K consecutive words have a hash, and of every
WINDOW - K + 1 consecutive hashes the least is kept, so both sides keep the same
hash for every shared span of WINDOW words.

1. Kept hashes of the items are one table, their distinct windows another.
2. One pass over the documents writes, for every row, its number of words and
   its kept hashes; those that an item keeps too name the texts to look at.
3. Only these texts are cut into windows. Hits extend to whole windows: a window
   must agree in its kept hash and in all its words, compared as text.
4. Texts are known by 128 bits of SHA-256, so equal rows are looked at together
   and rows without an id need none. Every join is left to the size of the
   written tables: small sides are broadcast by Spark, large ones are shuffled.

An item of fewer than WINDOW words is found by the hash of all its words: for
each such length (WINDOW - 1 at most) documents also keep all their hashes of
that length.

Defined cases: null or empty texts have no words and are clean; items without a
word hit nothing; an item with a null id hits words but is neither counted nor
listed; rows of one item id are one item; repeated rows of documents are judged
alike; empty tables give no rows or clean rows; extra columns are ignored; whole
texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.llm.common import documents, let, stored

WINDOW, K = 10, 5
#: Everything but digits, letters a-z and non-ASCII characters separates words (A-Z are lower-cased).
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; only A-Z are lower-cased (``lower`` changes other letters too, so it serves ASCII words)."""
    ascii_ = lambda w: F.octet_length(w) == F.length(w)
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), ""),
                       lambda w: F.when(ascii_(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _grams(hashes: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive word hashes."""
    return F.when(F.size(hashes) >= size, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size),
        lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]))).otherwise(_none())


def _kept(grams: Column) -> Column:
    """The least of every WINDOW - K + 1 consecutive hashes: one for each window, in order."""
    span = WINDOW - K + 1
    return F.when(F.size(grams) >= span, F.transform(
        F.sequence(F.lit(0), F.size(grams) - span),
        lambda i: F.least(*[F.get(grams, i + k) for k in range(span)]))).otherwise(_none())


def kept_hashes(ws: Column, short: list[int]) -> Column:
    """Distinct kept hashes of a text; ``short``: lengths of items below WINDOW words."""
    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.array_distinct(F.concat(
        let(_grams(h, K), _kept), *[_grams(h, n) for n in short])))


def windows(ws: Column, short: list[int]) -> Column:
    """Array of (at, size, kept hash, words as text) of every window of a text."""
    def cut(h: Column) -> Column:
        def of(kept: Column, size: int) -> Column:
            return F.transform(kept, lambda f, i: F.struct(
                i.alias("at"), F.lit(size).alias("size"), f.alias("kept"), F.array_join(F.slice(ws, i + 1, size), " ").alias("words")))
        return F.concat(let(_grams(h, K), lambda g: of(_kept(g), WINDOW)), *[of(_grams(h, n), n) for n in short])
    return let(F.transform(ws, lambda w: F.xxhash64(w)), cut)


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(distinct windows: kept, words), (words, item), lengths of items below WINDOW words (WINDOW - 1 at most)."""
    ws = stored(items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
                .filter(F.size("ws") > 0), "decon-items")
    short = sorted(r[0] for r in ws.filter(F.size("ws") < WINDOW).select(F.size("ws")).distinct().collect())
    whole = lambda n: F.when(F.size("ws") == n, windows(F.col("ws"), [n]))
    cut = F.coalesce(*[whole(n) for n in short], windows(F.col("ws"), []))
    cells = stored(ws.select("item", F.explode(cut).alias("w")).select("item", "w.kept", "w.words").distinct(), "decon-windows")
    return cells.select("kept", "words").distinct(), cells.filter("item IS NOT NULL").select("words", "item"), short


def _key() -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)


def covered(spans: Column) -> Column:
    """Number of words inside any of the (at, size) spans of a sorted array."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        F.greatest(s["end"], x["at"] + x["size"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).alias("n")), lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every row; ``items``: sorted ids as strings."""
    table, owners, short = item_windows(items)
    table = stored(table, "decon-table")
    kept = stored(table.select("kept").distinct(), "decon-kept")
    rows = stored(docs.select("doc_id", _key().alias("key"), words(F.col("text")).alias("ws"))
                  .select("doc_id", "key", F.size("ws").cast("long").alias("n_words"),
                          kept_hashes(F.col("ws"), short).alias("kept")), "decon-rows")
    suspects = stored(rows.select("key", F.explode("kept").alias("kept")).join(kept, "kept", "left_semi")
                      .select("key").distinct(), "decon-suspects")
    cut = (docs.select(_key().alias("key"), "text").join(suspects, "key", "left_semi")
           .select("key", words(F.col("text")).alias("ws"))
           .select("key", F.explode(windows(F.col("ws"), short)).alias("w")).select("key", "w.*"))
    hits = stored(cut.join(table, ["kept", "words"], "left_semi").select("key", "at", "size", "words").distinct(), "decon-hits")
    spans = hits.groupBy("key").agg(covered(F.array_sort(F.collect_set(F.struct("at", "size")))).alias("n_hit"))
    named = (hits.select("key", "words").distinct().join(owners, "words").select("key", "item").distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = stored(spans.join(named, "key", "left"), "decon-found")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "key", "n_words").join(found, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        (n_hit > 0).alias("contaminated"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      "contaminated")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
i AS (SELECT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (
  SELECT item_id, ws, least(len(ws), {WINDOW}) AS n, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS p FROM b WHERE len(ws) > 0)),
w AS (SELECT rid, p, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (
  SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
h AS MATERIALIZED (SELECT rid, p, n, g FROM w WHERE (n, g) IN (SELECT n, g FROM i)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT h.rid, i.item_id::VARCHAR AS item FROM h JOIN i USING (n, g) WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""
