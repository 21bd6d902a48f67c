import hashlib
from collections import Counter

import numpy as np

from playline.llm import fingerprint as P
from tests.llm.helpers import awkward, empty, prose, row


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    s = P.Sampler(2048)
    a, b = prose(1, 200), prose(1, 200)[:700] + " " + prose(2, 80)
    sig = s.signatures([a.encode(), b.encode(), a.encode()])
    assert abs(P.likeness(sig[:1], sig[1:2])[0] - jaccard(a, b)) < 0.04
    assert (sig[0] == sig[2]).all()
    # weights count: repeating every word twice halves the similarity
    twice = s.signatures([(a + " " + a).encode()])
    assert abs(P.likeness(sig[:1], twice)[0] - 0.5) < 0.04


def test_production_samples_estimate_the_similarity():
    rng, texts, want = np.random.default_rng(4), [], []
    for i in range(400):  # words of its own for every pair
        words = [f"p{i}x{j}" for j in range(60)]
        a = [str(w) for w in rng.choice(words, 150)]
        b = a[:int(rng.integers(60, 140))] + [str(w) for w in rng.choice(words, 40)]
        texts += [" ".join(a), " ".join(b)]
        want.append(jaccard(*texts[-2:]))
    sig = P.Sampler().signatures([t.encode() for t in texts])
    error = P.likeness(sig[::2], sig[1::2]) - np.array(want)
    assert abs(error.mean()) < 0.01 and np.sqrt((error ** 2).mean()) < 0.05


def test_next_document_and_edited_text(spark):
    texts = {i: prose(i, 20 + i) for i in range(11, 90)}
    docs = awkward(spark, [row(i, t) for i, t in texts.items()])
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = P.fingerprints(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for k, (i, t) in enumerate(order):
        new = P.edited(t, order[(k + 1) % len(order)][1])
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1,)}
    assert len(same) == 1
    assert P.fingerprints(empty(spark)).count() == 0


def test_one_row_is_its_own_next(spark):
    r = P.fingerprints(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0


def test_edited_takes_all_of_a_short_follower():
    assert P.edited("abcdef", "xy") == "abcxy" and P.edited("abcde", "xyz") == "abcxy" and P.edited("", "q") == ""


def test_uniforms_are_uniform():
    h = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for u in P.Sampler(8)._uniforms(h, 0):
        assert abs(u.mean() - 0.5) < 0.02 and 0 < u.min() and u.max() < 1
