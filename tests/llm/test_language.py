import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from playline.llm import language as L
from tests.llm.helpers import awkward, empty, row

SYLLABLES = {"aa": "ka to mi re su".split(), "bb": "ing th ed er wh".split(), "cc": "ção ñe lé ü ß".split()}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240):
    rows = [row(i, text(lang, i), lang) for i in range(100, 100 + n) for lang in [list(SYLLABLES)[i % 3]]]
    return spark.createDataFrame(rows, awkward(spark).schema)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_fold(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in L.op5_language(spark, str(tmp_path)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(truth)
    assert all(r["held_out"] == held(i) for i, r in got.items())
    out = [i for i in truth if held(i)]
    assert len(out) > 30 and np.mean([got[i]["lang_pred"] == truth[i] for i in out]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_rows_do_not_train(spark):
    docs = corpus(spark, 60)
    changed = docs.rdd.map(lambda r: row(r["doc_id"], "zzz qqq" if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else r["text"], r["lang"]))
    a, b = L.train(docs), L.train(spark.createDataFrame(changed, docs.schema))
    assert a["langs"] == b["langs"] and np.array_equal(a["w"], b["w"])


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = L.predict(docs.select("doc_id", "text"), L.train(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] in (5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert L.train(empty(spark)) is None
    assert all(r["lang_pred"] == "und" for r in L.predict(docs.select("doc_id", "text"), None).collect())


def test_codewords_are_apart():
    for n in (2, 4, 20):
        c = L.codebook(n)
        d = (c[:, None, :] != c[None, :, :]).sum(2)
        assert d[~np.eye(n, dtype=bool)].min() >= 3


def test_decoding_survives_a_wrong_bit():
    c = L.codebook(4)
    m = 3 * c[2].copy()
    m[0] = -m[0]
    best, score = L.decode(m[None, :], c)
    assert best[0] == 2 and score[0] > 0.5


def test_a_repeated_id_takes_one_place_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_LANGUAGE", 20)
    docs = corpus(spark)
    want = L.train(docs)
    least = docs.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(3)
    for _ in range(6):
        least = least.union(least)
    got = L.train(docs.union(least))
    assert got["langs"] == want["langs"] and np.allclose(got["w"], want["w"])
