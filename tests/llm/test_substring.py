import hashlib
import random
import re

import numpy as np
import pytest

from playline.llm import substring as S
from tests.llm.helpers import awkward, empty, prose, row

N = S.WINDOW


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - N + 1):
            if i is not None:
                g = tuple(w[k:k + N])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - N + 1) if i is not None and first[tuple(w[k:k + N])] < i for p in range(k, k + N)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(spark):
    rng = random.Random(6)
    passage, common = prose(70, 40), prose(71, 20)
    rows = [row(100 + k, " ".join([prose(200 + k, rng.randint(0, 40)), passage if k % 3 == 0 else "", prose(400 + k, 10),
                                   common if k % 2 else "", prose(600 + k, 5)])) for k in range(120)]
    rows += [row(300, "x " * 60), row(301, passage[:200]), row(302, common)]
    return awkward(spark, rows)


@pytest.mark.parametrize("hot_share", [4096, 4])
def test_cut_matches_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(S, "HOT_SHARE", hot_share)
    docs = corpus(spark)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.cut(docs).collect()]
    assert sorted(got, key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_full_sketch_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_CELLS_BITS", 11)
    docs = corpus(spark)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.cut(docs, max_bits=11).collect()]
    assert sorted(got, key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_sketch_never_underestimates(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH", 500)
    docs = S._binary(corpus(spark))
    est = S.estimate(docs)
    h = np.concatenate([S.window_hashes([r["text"]])[1] for r in docs.filter("doc_id IS NOT NULL").collect()])
    value, count = np.unique(h, return_counts=True)
    assert est.repeated(value[count > 1]).all()
    assert est.repeated(value[count == 1]).mean() < 0.2


def test_packing():
    rng = np.random.default_rng(1)
    for size, n in ((10, 10), (100_000, 50), (1 << 20, 3000), (255, 1), (600, 2)):
        o = np.unique(rng.integers(0, size, n))
        assert (S.unpack(S.pack(o)) == o).all()


def test_empty(spark):
    assert S.cut(empty(spark)).count() == 0
    assert S.cut(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()["n_removed"] == 0


def test_thue_morse_windows_stay(spark):
    from tests.llm.test_words import thue_morse

    texts = [" ".join([thue_morse(n, a, b)] * 13) for n in (1024, 4096) for a, b in ("ab", "ba")]
    texts += [" ".join(thue_morse(512, a, b)) for a, b in ("ab", "ba")] + [" ".join([thue_morse(64, "b", "a")] * 20)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.cut(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(list(enumerate(texts))) and sum(r[2] for r in got) < sum(r[1] for r in got) / 2
