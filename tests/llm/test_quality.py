import math
import re
from collections import Counter

import pytest

from playline.llm import quality as Q
from tests.llm.helpers import SCHEMA, awkward, empty, prose, row


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    c = Counter(win)
    rep = len({p for i, w in enumerate(win) if c[w] > 1 for p in (i, i + 1, i + 2)})
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), rep,
            len(words) < 50 or 100 * rep > 50 * len(words))


def test_measures_match_brute_force(spark):
    texts = [prose(i, i) for i in range(0, 130, 7)] + ["a b c a b c", "x\nx\n\nx \ny", "# * $ %% &| <>", "a " * 500, "l\n" * 40,
                                                       "\x0ba\x0cb\rc\td e"]
    docs = awkward(spark, [row(100 + i, t) for i, t in enumerate(texts)])
    got = Q.measures(docs.select("doc_id", "lang", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
    assert Q.measures(empty(spark).select("doc_id", "lang", "text")).count() == 0


@pytest.mark.parametrize("n,p,k", [(10, 0.1, 0), (50, 0.05, 3), (400, 0.01, 9), (3, 0.5, 3), (2000, 0.005, 4)])
def test_binomial_cdf(n, p, k):
    want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    assert Q.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """Bad documents shout; a cutoff is certified for the big stratum and none for the small one."""
    good = [row(i, prose(i, 80)) for i in range(1, 3001)]
    bad = [row(5000 + i, " ".join(f"w{i}x{j}!!" for j in range(80))) for i in range(300)]
    few = [row(9000 + i, prose(i, 80), "fr") for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, source string, n_chars long, a string, b int, c string")
    labels = spark.createDataFrame([(r[0], 0 if 5000 <= r[0] < 9000 else 1, 0) for r in good + bad + few] + [(None, 1, 0), (1, None, 0), (2, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels).collect()}
    assert not any(out[5000 + i] for i in range(300))
    assert sum(not out[i] for i in range(1, 3001)) <= Q.ALPHA * 3000
    assert all(out[9000 + i] for i in range(20))
    kept = Q.filter_docs(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in out.items() if k}


def test_small_languages_share_a_pool(spark):
    """Three languages that certify nothing alone: 240, 230 and 0 good labels. Together 470 support a risk of 2 %."""
    langs = ("de", "fr", None)
    good = [row(1000 * (i % 2) + i, prose(i, 80), langs[i % 2]) for i in range(470)]
    bad = [row(5000 + i, " ".join(f"w{i}x{j}!!" for j in range(80)), langs[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(good + bad + [row(7000, bad[0][1], "unlabelled")], SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000), 0) for r in good + bad], "doc_id long, quality int, toxic int")
    m = Q.measures(docs.select("doc_id", "lang", "text")).drop("text")
    cutoffs = Q.thresholds(m, labels)
    assert {lang for lang, _ in cutoffs} == set(langs) and len({(r, c) for (_, r), c in cutoffs.items()}) == len(cutoffs) / 3
    level = Q.DELTA / (4 * len(Q.RULES))
    assert Q.certified(0, 470, 0.02, level) and not Q.certified(0, 470, 0.01, level) and not Q.certified(0, 240, 0.02, level)
    assert not Q.thresholds(m, labels, pool_risks=(0.005, 0.01))
    out = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels).collect()}
    assert {i for i, k in out.items() if k} == {r[0] for r in good} | {7000}


def test_pooled_matches_sql(spark, tmp_path):
    """One language on its own, two in the pool, against the DuckDB statement."""
    import duckdb
    rows = [row(i, prose(i, 60 + i % 9) + " !" * (i % 7), ("en", "en", "en", "de", "fr")[i % 5]) for i in range(2400)]
    rows += [row(5000 + i, prose(i, 60) + " #" * (20 + i), ("en", "de", None)[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000 or i % 20 == 0), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = {r[0]: r[-1] for r in con.execute(Q.ORACLE).fetchall()}
    got = {r["doc_id"]: r["kept"] for r in Q.op6_quality_rules(spark, str(tmp_path)).collect()}
    assert got == want
    lost = {d for d, k in got.items() if not k}
    assert {"en", "de", None} <= {r[2] for r in rows if r[0] in lost}


def test_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    got = Q.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["kept"] == (not r["base_failed"])
    assert Q.filter_docs(empty(spark), labels).count() == 0


def test_plan_has_no_python(spark):
    plan = Q.measures(awkward(spark).select("doc_id", "lang", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
