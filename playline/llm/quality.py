"""Quality rules with risk-controlled thresholds.

Every rule is a number per document and rejects it at or above a cutoff. The
cutoffs come from labelled documents: per stratum (language) and rule, the
false-rejection count ``k`` among ``n`` good documents is tested against the
exact binomial law; a cutoff is certified when the Clopper-Pearson upper bound
of its false-rejection rate stays within ``alpha`` at level
``delta / ((languages + 1) * rules)``. ``k`` falls as the cutoff rises, so each
(stratum, rule) pair is one fixed-sequence test and Bonferroni over the pairs
bounds the family-wise error by ``delta``. Among the certified cutoffs the one
with the best (bad rejected - cost * good rejected) is used; ties take the laxest.

Languages with so few good labels that not even 0 false rejections would certify
anything form one pooled stratum with its own share of ``delta``: its cutoffs hold
for all of them, and the bound for their documents taken together. If the pool is
too small for ``alpha`` it is tested at the least of ``pool_risks`` that its size
can support. Pool and risk follow from counts of good labels alone, never from
what the rules reject.

Defined cases: null or empty text has no words (all counts 0, base rule
rejects it); null lang is a language of its own; a pool too small for every
risk certifies nothing, so only the base rule applies; so it does in languages
without labels; repeated documents
each count; several labels for one id count once, good if any says good; null
ids match no label. Extra columns of ``docs`` are left alone by ``filter_docs``.
Repeated three-word windows are found by their 64-bit hash within a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.llm.common import documents, stored, text_of, words_of

ALPHA, DELTA, COST = 0.005, 0.05, 20
POOL_RISKS = (0.005, 0.01, 0.02)    # risks the pool of small languages may be tested at, never below alpha
RULES: dict[str, list[float]] = {
    "symbol_rate": [0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9],
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45],
    "shout_rate": [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5],
    "word_length": [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0],
}


def _repeat_words(words: Column, n: Column) -> Column:
    """Hash of each three-word window, in order of position."""
    return F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))


def measures(df: DataFrame) -> DataFrame:
    """Append the base counts and the rule numbers of every whole ``text``."""
    t = "_t"
    d = df.withColumn(t, text_of())
    d = (d.withColumn("_words", words_of(F.col(t)))
          .withColumn("_lines", F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
          .withColumn("_wc", F.length(F.regexp_replace(F.col(t), r"[\x20\x09-\x0D]+", "")).cast("long"))
          .withColumn("_sym", F.length(F.regexp_replace(F.col(t), r"[^#*$%&|<>]+", "")).cast("long"))
          .withColumn("_bang", F.length(F.regexp_replace(F.col(t), r"[^!?]+", "")).cast("long")))
    d = (d.withColumn("_n", F.size("_words"))
          .withColumn("_h", _repeat_words(F.col("_words"), F.size("_words")))
          .withColumn("_nl", F.size("_lines"))
          .withColumn("_dl", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    s, m = F.col("_s"), F.size("_s")
    flagged = F.filter(F.transform(s, lambda x, j: F.when(
        ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
        | ((j < m - 1) & (s[F.least(j + 1, m - 1)]["h"] == x["h"])), x["i"])), lambda i: i.isNotNull())
    rep = F.size(F.array_distinct(F.flatten(F.transform(flagged, lambda i: F.array(i, i + 1, i + 2)))))
    d = d.withColumn("_rep", F.when(F.size("_s") > 0, rep).otherwise(F.lit(0)).cast("long"))
    n1 = F.greatest(F.col("_n"), F.lit(1))
    out = {
        "n_words": F.col("_n").cast("long"), "word_chars": F.col("_wc"), "n_symbols": F.col("_sym"),
        "n_dup_lines": F.col("_dl"), "n_repeat_words": F.col("_rep"),
        "base_failed": (F.col("_n") < 50) | (F.col("_rep") * 100 > F.col("_n") * 50),
        "symbol_rate": F.col("_sym") / n1, "dup_line_share": F.col("_dl") / F.greatest(F.col("_nl"), F.lit(1)),
        "repeat_share": F.col("_rep") / n1, "shout_rate": F.col("_bang") / n1, "word_length": F.col("_wc") / n1}
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(k) for k, v in out.items()])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from k downwards until terms no longer count."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    log_term = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                + k * math.log(p) + (n - k) * math.log1p(-p))
    term, total = 1.0, 0.0
    for i in range(k, -1, -1):
        total += term
        if i == 0 or term < total * 1e-17 and i < n * p:
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
    return min(1.0, math.exp(log_term + math.log(total)))


def certified(k: int, n: int, alpha: float, level: float) -> bool:
    """True if the exact upper bound at ``1 - level`` of k out of n is at most alpha."""
    return n > 0 and binomial_cdf(k, n, alpha) <= level


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
               cost: float = COST, pool_risks=POOL_RISKS) -> dict[tuple[str | None, str], float]:
    """Certified cutoff per (language, rule).

    One aggregate over all labelled documents; what reaches the driver is one
    row of counts per language."""
    lab = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy("doc_id").agg((F.max("quality") > 0).alias("_good")))
    # conditions stay inside the sums: a filter would be pushed below the measures and repeat them
    rows, judged = measured.join(lab, "doc_id"), ~F.col("base_failed")
    sums = [F.count_if(judged).alias("judged"), F.count_if(judged & F.col("_good")).alias("n")]
    for rule, grid in RULES.items():
        for j, c in enumerate(grid):
            hit = judged & (F.col(rule) >= c)
            sums += [F.count_if(hit & F.col("_good")).alias(f"g_{rule}_{j}"),
                     F.count_if(hit & ~F.col("_good")).alias(f"b_{rule}_{j}")]
    counts = [r for r in rows.groupBy("lang").agg(*sums).collect() if r["judged"]]
    level = delta / ((len(counts) + 1) * len(RULES))
    able = lambda n, a: certified(0, n, a, level)
    strata = [([r["lang"]], alpha, [r]) for r in counts if able(r["n"], alpha)]
    pool = [r for r in counts if not able(r["n"], alpha)]
    risk = next((a for a in sorted({alpha, *pool_risks}) if a >= alpha and able(sum(r["n"] for r in pool), a)), None)
    if risk is not None:
        strata.append(([r["lang"] for r in pool], risk, pool))
    chosen = {}
    for langs, a, members in strata:
        total = lambda name: sum(r[name] for r in members)  # noqa: E731,B023
        for rule, grid in RULES.items():
            best = None
            for j in reversed(range(len(grid))):  # laxest first
                good, bad = total(f"g_{rule}_{j}"), total(f"b_{rule}_{j}")
                if not certified(good, total("n"), a, level):
                    break
                score = bad - cost * good
                if score > 0 and (best is None or score > best[0]):
                    best = (score, grid[j])
            if best:
                chosen.update({(lang, rule): best[1] for lang in langs})
    return chosen


def verdict(cutoffs: dict[tuple[str | None, str], float]) -> Column:
    """Kept: passes the base rule and every certified cutoff of its stratum."""
    reject = F.lit(False)
    for (lang, rule), c in sorted(cutoffs.items(), key=lambda x: (x[0][0] is not None, x[0][0] or "", x[0][1])):
        reject = reject | (F.col("lang").eqNullSafe(F.lit(lang)) & (F.col(rule) >= c))
    return ~F.col("base_failed") & ~reject


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: base counts, rule numbers and the verdict ``kept``."""
    m = stored(measures(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    return m.withColumn("kept", verdict(thresholds(m, labels, alpha, delta)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    # measured once and written beside the documents: the cutoffs and the filter both read the result
    m = stored(measures(docs.select(F.struct("*").alias("_doc"), "doc_id", "lang", "text")).drop("text"), "quality")
    return m.filter(verdict(thresholds(m, labels))).select("_doc.*")


def _sql() -> str:
    """Independent statement of the whole operator in DuckDB."""
    cut = ", ".join(f"('{r}', {c})" for r, g in RULES.items() for c in g)
    ws = r"[\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, t, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, concat_ws(' ', ws[i], ws[i+1], ws[i+2]) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM dup) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '{ws}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^!?]+', '', 'g')) AS bang, len(ls) AS n_lines
  FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
v AS (SELECT rid, doc_id, lang, base_failed, r.rule, CASE r.rule
   WHEN 'symbol_rate' THEN n_symbols / greatest(n_words, 1) WHEN 'dup_line_share' THEN n_dup_lines / greatest(n_lines, 1)
   WHEN 'repeat_share' THEN n_repeat_words / greatest(n_words, 1) WHEN 'shout_rate' THEN bang / greatest(n_words, 1)
   ELSE word_chars / greatest(n_words, 1) END AS x
  FROM f, (VALUES {", ".join(f"('{r}')" for r in RULES)}) AS r(rule)),
cut(rule, c) AS (VALUES {cut}),
lab AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lv AS (SELECT v.*, good FROM v JOIN lab USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT lang, count(DISTINCT rid) FILTER (good) AS n FROM lv GROUP BY lang),
lev AS (SELECT {DELTA} / ((count(*) + 1) * {len(RULES)}) AS level FROM strata),
own AS (SELECT lang, n, pow(1 - {ALPHA}, n) <= level AS alone FROM strata, lev),
part AS (SELECT lang, alone, CASE WHEN alone THEN lang END AS stratum FROM own),
size AS (SELECT alone, CASE WHEN alone THEN lang END AS stratum, sum(n)::BIGINT AS n FROM own GROUP BY ALL),
risk AS (SELECT alone, stratum, n, level, min(r) AS a FROM size, lev, (VALUES {", ".join(f"({a})" for a in POOL_RISKS)}) AS t(r)
  WHERE pow(1 - r, n) <= level GROUP BY ALL),
k AS (SELECT alone, stratum, rule, c, count(*) FILTER (good AND x >= c) AS g, count(*) FILTER (NOT good AND x >= c) AS b
  FROM lv JOIN cut USING (rule) JOIN part ON part.lang IS NOT DISTINCT FROM lv.lang GROUP BY ALL),
ok AS (SELECT k.*, n > 0 AND list_sum(list_transform(range(0, g + 1), lambda i: CASE WHEN i > n THEN 0 ELSE
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a)) END))
    <= level AS good_enough
  FROM k JOIN risk ON k.alone = risk.alone AND k.stratum IS NOT DISTINCT FROM risk.stratum),
pick AS (SELECT alone, stratum, rule, c FROM ok WHERE good_enough AND b - {COST} * g > 0
  QUALIFY row_number() OVER (PARTITION BY alone, stratum, rule ORDER BY b - {COST} * g DESC, c DESC) = 1),
bad AS (SELECT DISTINCT rid FROM v JOIN part ON part.lang IS NOT DISTINCT FROM v.lang
  JOIN pick p ON p.rule = v.rule AND p.alone = part.alone AND p.stratum IS NOT DISTINCT FROM part.stratum WHERE x >= c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.rid IS NULL AS kept FROM f LEFT JOIN bad USING (rid)"""


ORACLE = _sql()
