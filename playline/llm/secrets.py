"""Secret scan over an incremental blob ledger.

Each document version is addressed by the SHA-256 of its whole text. The ledger
is a Parquet table with one row per scan of a blob: which rule versions were
applied (``keys``) and what they found. A run keeps one text per blob, asks the
ledger which (blob, rule version) pairs are new, scans only those, appends
them, and joins all findings of a blob back to every path that holds it.

Positions come from the built-in regular-expression functions: the text split
at the matches and the matches themselves give running lengths in code points.

Defined cases: a null text is the empty text; equal texts share one scan; null
or repeated ids each keep their row; an empty table gives no rows; a text
without match has empty findings; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.llm.common import documents, stored, text_of
from playline.session import shared_path

SPANS = "array<struct<s:int,k:int,e:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0      # the group whose length is tested
    least: int = 1      # its least length in code points
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules. Runs of access and hex characters are
# taken whole, so their least length is part of the pattern; for assignments a
# match that is too short still uses up its text and is dropped afterwards.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
    Rule("vendor", 1, r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
                      r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", base=False),
)


def _spans(rule: Rule, k: int) -> Column:
    """Spans of one rule from the split pieces ``_p``, matches ``_m`` and tested groups ``_g``."""
    return F.expr(f"""
      if(_p{k} is null, cast(array() as {SPANS}),
        aggregate(sequence(1, size(_m{k})), cast(named_struct('pos', 0, 'out', array()) as struct<pos:int,out:{SPANS}>),
          (a, i) -> named_struct('pos', a.pos + length(_p{k}[i - 1]) + length(_m{k}[i - 1]), 'out',
            if(length(_g{k}[i - 1]) >= {rule.least},
               concat(a.out, array(named_struct('s', a.pos + length(_p{k}[i - 1]), 'k', {k},
                 'e', a.pos + length(_p{k}[i - 1]) + length(_m{k}[i - 1])))), a.out)),
          a -> a.out))""")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each blob for the rule keys in its ``missing`` array."""
    cols = blobs.columns
    for k, r in enumerate(rules):
        hit = F.array_contains("missing", r.key) & F.col("text").rlike(r.pattern)
        blobs = (blobs.withColumn(f"_p{k}", F.when(hit, F.split("text", r.pattern, -1)))
                 .withColumn(f"_m{k}", F.when(F.col(f"_p{k}").isNotNull(),
                                              F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))))
                 .withColumn(f"_g{k}", F.when(F.col(f"_p{k}").isNotNull(),
                                              F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)))))
    found = F.concat(*[_spans(r, k) for k, r in enumerate(rules)])
    return blobs.select(*[c for c in cols if c != "text"], F.sort_array(found).alias("found"))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hadoop) else None


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) for every row of ``docs``; new scans are appended to ``ledger``.

    ``found`` is an array of (start, kind index, end), in code points, ordered.
    The append is one Parquet write of this run's new pairs; a run that fails
    before it leaves the ledger as it was and is simply run again."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    paths = docs.select("doc_id", text_of().alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))  # combined map-side: a hot blob is one row a task
    past = _ledger(docs.sparkSession, ledger)
    if past is None:
        blobs = blobs.withColumn("missing", keys).withColumn("old", F.array().cast(SPANS))
    else:
        # stored kinds are names, so the ledger outlives a change of the rule list
        index = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
        # two runs at once may have written the same pairs: equal keys and findings count once
        past = (past.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("done"),
                                         F.array_distinct(F.flatten(F.collect_set("findings"))).alias("_f")))
        blobs = (blobs.join(past, "blob", "left")
                 .withColumn("missing", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
                 .withColumn("old", F.coalesce(F.transform(
                     F.filter("_f", lambda x: F.array_contains(keys, x["key"])),
                     lambda x: F.struct(x["s"].alias("s"), index[x["key"]].alias("k"), x["e"].alias("e"))),
                     F.array().cast(SPANS)))
                 .drop("done", "_f"))
    done = stored(scan_blobs(blobs, rules), "secret-scan")
    names = F.array(*[F.lit(r.key) for r in rules])
    (done.filter(F.size("missing") > 0)
     .select("blob", F.col("missing").alias("keys"), F.transform("found", lambda x: F.struct(
         names[x["k"]].alias("key"), x["s"].alias("s"), x["e"].alias("e"))).alias("findings"))
     .write.mode("append").parquet(ledger))
    hits = (done.select("blob", F.sort_array(F.concat("old", "found")).alias("found")).filter(F.size("found") > 0))
    return (paths.select("doc_id", "blob").join(hits, "blob", "left")
            .select("doc_id", F.coalesce("found", F.array().cast(SPANS)).alias("found")))


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    last = max(k for k, r in enumerate(rules) if r.base)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["k"] <= last)
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against a ledger that starts empty for this run."""
    return digests(scan(documents(spark, sf_dir), shared_path(spark, "secret-ledger")))


def _sql() -> str:
    """Independent statement: RE2 matches, prefix sums of piece lengths."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")
        if r.kind == "hex":
            p = "[0-9a-f]+"
        least = 24 if r.kind == "hex" else r.least
        parts.append(f"""SELECT rid, {k} AS k, '{r.kind}' AS kind,
  (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS s,
  (list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))::BIGINT AS e
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_split_to_array(t, '{p}') AS ps,
    regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {r.group}) AS gs FROM d
    WHERE regexp_matches(t, '{p}'))) WHERE length(gs[i]) >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k <= 2) AS b,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS al FROM f GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(al, '') AS spans FROM d LEFT JOIN g USING (rid)"""


ORACLE = _sql()
