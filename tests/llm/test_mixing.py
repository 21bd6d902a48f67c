import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from playline.llm import mixing as M
from tests.llm.helpers import awkward, empty, prose, row


def corpus(spark, n=400):
    rows = [row(i, prose(i, 5 + i % 40), source=["b", "a", "c", "d", None][i % 5 if i % 7 else 0]) for i in range(1000, 1000 + n)]
    return awkward(spark, rows)


def fill(totals):
    """Targets by repeated sharing of the excess."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(totals.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = [s for s in open_ if unit * w[s] >= 2 * totals[s]]
        if not full:
            out.update({s: unit * w[s] for s in open_})
            break
        for s in full:
            out[s] = 2.0 * totals[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("fanout", [2, 7, 256])
def test_targets_and_taken_words(spark, fanout):
    docs = corpus(spark)
    rows = M.mix(docs, fanout).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, biggest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        totals[r["source"]] += size(r["text"])
    copies = defaultdict(int)
    for r in rows:
        copies[(r["doc_id"], r["source"], r["size"])] += 1
    for r in rows:
        biggest[r["source"]] = max(biggest[r["source"]], r["size"] * copies[(r["doc_id"], r["source"], r["size"])])
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == totals[r["source"]]
    want = fill(totals)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= biggest[s] + 1e-6


def test_reruns_agree_and_copies_keep_columns(spark):
    docs = corpus(spark, 120)
    one, two = (sorted(map(tuple, M.mix(d).drop("target").collect()), key=str) for d in (docs, docs.repartition(7)))
    assert one == two
    out = M.copies(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in M.mix(docs).collect())


def test_probabilities_are_kept(spark):
    """Over many seeds a document is drawn as often as its probability says."""
    sized = spark.createDataFrame([(i, "s", 10 + i) for i in range(12)], "doc_id long, source string, size long").cache()
    goal = spark.createDataFrame([("s", 186, 0.4 * 186, 0, 0.4)], "source string, source_size long, target double, whole long, frac double")
    hits, seed = defaultdict(int), M.SEED
    try:
        for k in range(40):
            M.SEED = 1000 * k + 5
            for r in M.draw(sized, goal, 4).collect():
                hits[r["doc_id"]] += r["up"]
    finally:
        M.SEED = seed
    assert 0.3 < sum(hits.values()) / 480 < 0.5 and min(hits[i] for i in range(12)) >= 5


def test_empty_and_blank(spark):
    assert M.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in M.mix(blank).collect()] == [0, 0]


def test_plan_has_no_python(spark):
    plan = M.sizes(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert F is not None
