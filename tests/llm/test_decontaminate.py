import random
import re

import pytest

from playline.llm import decontaminate as X
from tests.llm.helpers import awkward, empty, prose, row

ITEMS = "item_id long, text string, doc_id int, kept string, ws int"


def words(text):
    low = (text or "").translate(str.maketrans(X.UPPER, X.LOWER))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - X.WINDOW, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + X.WINDOW]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = words(t)
        at = [(k, n) for n in sizes for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows]
        hit = {p for k, n in at for p in range(k, k + n)}
        found = sorted({str(x) for k, n in at for x in windows[tuple(w[k:k + n])] if x is not None})
        out.append((i, len(w), len(hit), len(found), found, bool(hit)))
    return sorted(out, key=str)


def tables(spark):
    rng = random.Random(3)
    items = [(k, prose(900 + k, rng.randint(10, 40)).title(), 1, "k", 2) for k in range(30)]
    items += [(k, prose(960 + k, k - 40), 1, "k", 2) for k in range(41, 50)]                      # 1 to 9 words
    items += [(50, items[0][1], 1, "k", 2), (50, items[3][1], 1, "k", 2), (None, prose(990, 20), 1, "k", 2), (51, None, 1, "k", 2), (52, " .,- ", 1, "k", 2),
              (53, "a a a a a a a a a a a a", 1, "k", 2), (54, "École ÉCOLE été Straße " * 4, 1, "k", 2), (2**40, items[1][1], 1, "k", 2)]
    rows = []
    for k in range(60):
        w = prose(300 + k, 60).split()
        part = items[rng.randrange(len(items))][1] or ""
        lo = rng.randint(0, 6)
        inside = re.split(r"\s", part)[lo:lo + rng.choice([8, 9, 10, 11, 40])]
        rows.append(row(100 + k, " ".join(w[:20]) + "; " + "... ".join(inside).upper() + "\n" + " ".join(w[20:])))
    rows += [row(200, "A a, " * 40), row(201, "x École ÉCOLE été Straße École ÉCOLE été Straße École ÉCOLE été Straße"),
             row(202, "École école été Straße École ÉCOLE été Straße École ÉCOLE été"), row(203, prose(990, 20)), row(204, items[0][1])]
    rows += [row(300 + k, items[5][1] + " tail") for k in range(40)]
    return awkward(spark, rows), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("short", [True, False])
def test_matches_brute_force(spark, short):
    docs, items = tables(spark)
    if not short:
        items = items.filter("item_id < 40 OR item_id > 49 OR item_id IS NULL")
    got = sorted((tuple(r) for r in X.contamination(docs, items).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and sum(r[5] for r in got) > 40


def test_shuffled_joins_give_the_same(spark):
    docs, items = tables(spark)
    want = sorted(map(str, X.contamination(docs, items).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, X.contamination(docs, items).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_empty(spark):
    docs, items = tables(spark)
    none = spark.createDataFrame([], ITEMS)
    assert X.contamination(empty(spark), items).count() == 0
    assert X.contamination(docs, none).filter("contaminated OR n_items > 0 OR n_hit > 0").count() == 0
