import random
import re

import numpy as np
import pytest

from playline.llm import jaccard as J
from playline.llm.components import components
from tests.llm.helpers import SCHEMA, awkward, empty, prose, row


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
    return " ".join(w)


def brute(rows):
    """(id, class, copy, links, text links) of every row from all pairs."""
    sets = [(r[0] if r[0] is not None else J.NO_ID, shingles(r[1])) for r in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    n = len(sets)
    links = [[k for k in range(n) if k != i and near(sets[i][1], sets[k][1])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[k] for k in links[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i, (d, s) in enumerate(sets):
        out.append((d, min(sets[k][0] for k in range(n) if root[k] == root[i]), min(x for x, t in sets if t == s),
                    len(links[i]), len({sets[k][1] for k in links[i]} - {s})))
    return sorted(out)


def corpus(spark):
    rows = []
    for g in range(6):
        base = prose(g, 150)
        rows += [row(100 * (g + 1) + k, edited(base, k, k % 5) if k % 4 else base) for k in range(20)]
    rows += [row(5000 + k, prose(900 + k, 100)) for k in range(40)]
    rows += [row(6000 + k, "one two three") for k in range(3)]
    return awkward(spark, rows)


@pytest.mark.parametrize("block", [3, 512])
def test_classes_and_links_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    docs = corpus(spark)
    got = sorted((r["id"], r["class_id"], r["copy_id"], r["n_links"], r["n_text_links"]) for r in J.classes(docs).collect())
    assert got == brute([tuple(r) for r in docs.collect()])


def test_deduplicate_keeps_one_of_each(spark):
    docs = corpus(spark)
    out = J.deduplicate(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] if r["doc_id"] is not None else J.NO_ID for r in out.collect()]
    assert sorted(kept) == sorted({c for _, c, *_ in brute([tuple(r) for r in docs.collect()])} | set()) or len(kept) == len(
        {(c, s) for c, s in {(r["class_id"], r["root"]) for r in J.classes(docs).collect()}})
    assert J.classes(empty(spark)).count() == 0 and J.deduplicate(empty(spark)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    need = J.least_matches()
    assert need == sorted(need) and need[0] < 16 * 0.8
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 60000, (1, J.BANDS * J.ROWS)).astype(np.uint16).repeat(3, axis=0)
    sig[1, rng.random(sig.shape[1]) > 0.8] += 1
    sig[2, rng.random(sig.shape[1]) > 0.3] += 1
    i, j = J.survivors(sig, np.array([100, 100, 100]), np.arange(3), None, need)
    assert list(zip(i, j)) == [(0, 1)]


def test_signature_estimates_similarity():
    a = prose(1, 400)
    sets = J.shingle_sets([a.encode(), edited(a, 1, 12).encode()])
    s = J.signatures(sets)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in edges)}


def test_thue_morse_texts_are_no_copies(spark):
    from tests.llm.test_words import thue_morse

    texts = [" ".join([thue_morse(n, a, b)] * 13) for n in (64, 1024, 8192) for a, b in ("ab", "ba")]
    texts += [" ".join(thue_morse(1024, a, b)) for a, b in ("ab", "ba")] + [thue_morse(2048), thue_morse(2048, "b", "a")]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA)
    got = sorted((r["id"], r["class_id"], r["copy_id"], r["n_links"], r["n_text_links"]) for r in J.classes(docs).collect())
    assert got == brute(list(enumerate(texts)))
    assert J.deduplicate(docs).count() == len({c for _, c, *_ in got}) > 6


def test_clashing_names_are_parted(spark):
    rows = [(1, 7, 1, 3, b"a"), (2, 7, 1, 3, b"a"), (3, 7, 2, 5, b"b"), (4, 8, 1, 9, b"c"), (5, 7, 3, 5, b"d")]
    described, nodes = J.nodes_of(spark.createDataFrame(rows, "id long, name long, twin long, n long, sig binary"))
    of = {r["id"]: r["node"] for r in described.collect()}
    assert of[1] == of[2] and len(set(of.values())) == 4
    assert sorted((r["rep"], r["copies"], r["n"], r["name"], r["twin"]) for r in nodes.collect()) == [
        (1, 2, 3, 7, 1), (3, 1, 5, 7, 2), (4, 1, 9, 8, 1), (5, 1, 5, 7, 3)]
