import inspect
import math
import re

from tokenizers import Tokenizer

import corpus_pipeline as C
import __spark_entry__ as entry
from playline.llm import bpe, pii, quality
from tests.llm.helpers import SCHEMA, prose, row
from tests.llm.test_jaccard import shingles
from tests.llm.test_mixing import fill
from tests.llm.test_pii import brute as plain_spans
from tests.llm.test_quality import brute as brute_measures

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "redact_pii", "mix_sources", "encode_bpe"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in C.STAGES)
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11))


def plain_kept(rows, labels, alpha=0.005, delta=0.05, cost=20):
    """Ids that pass the base rule and every cutoff whose exact binomial bound holds, laxest cutoff first."""
    seen, good = {}, {}
    for d, q in labels:
        good[d] = good.get(d, False) or q > 0
    for d, lang, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = sum(1 for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        n, chars, symbols, dups, repeated, failed = brute_measures(text)
        shouts = sum(c in "!?" for c in text or "")
        n = max(1, len(words))
        seen[d] = lang, failed, {"symbol_rate": symbols / n, "dup_line_share": dups / max(1, lines), "repeat_share": repeated / n,
                                 "shout_rate": shouts / n, "word_length": chars / n}
    judged = [(lang, good[d], v) for d, (lang, failed, v) in seen.items() if d in good and not failed]
    langs = {x[0] for x in judged}
    level = delta / ((len(langs) + 1) * 5)
    count = {x: sum(g for lang, g, _ in judged if lang == x) for x in langs}
    small = {x for x in langs if (1 - alpha) ** count[x] > level}
    together = sum(count[x] for x in small)
    risks = [a for a in (0.005, 0.01, 0.02) if (1 - a) ** together <= level]
    strata = [({x}, alpha) for x in langs - small] + ([(small, risks[0])] if risks else [])
    cutoffs = []
    for members, a in strata:
        mine = [(g, v) for x, g, v in judged if x in members]
        n = sum(g for g, _ in mine)
        for rule, grid in quality.RULES.items():
            best = None
            for c in reversed(grid):
                lost = sum(g and v[rule] >= c for g, v in mine)
                if sum(math.comb(n, i) * a ** i * (1 - a) ** (n - i) for i in range(lost + 1)) > level:
                    break
                score = sum(not g and v[rule] >= c for g, v in mine) - cost * lost
                if score > 0 and (best is None or score > best[0]):
                    best = score, c
            if best:
                cutoffs += [(x, rule, best[1]) for x in members]
    return cutoffs, {d for d, (lang, failed, v) in seen.items()
                     if not failed and not any(x == lang and v[rule] >= c for x, rule, c in cutoffs)}


def test_quality_stage_against_plain_bounds(spark, tmp_path):
    """Enough good documents of one language for a certified cutoff; a second language stays below."""
    good = [row(i, prose(i, 60 + i % 9)) for i in range(1400)] + [row(3000 + i, prose(i, 70), "fr") for i in range(30)]
    bad = [row(2000 + i, " ".join(f"{w}{'#' * (1 + i % 3)}" for w in prose(i, 60).split()), "fr" if i % 4 == 0 else "en") for i in range(60)]
    docs = spark.createDataFrame(good + bad + [row(4000, "too short"), row(4001, None)], SCHEMA)
    marks = [(r[0], int(r[0] < 2000 or r[0] >= 3000)) for r in good + bad]
    spark.createDataFrame([(*m, 0) for m in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    cutoffs, keep = plain_kept([(r[0], r[2], r[1]) for r in good + bad] + [(4000, "en", "too short"), (4001, "en", None)], marks)
    assert {c[0] for c in cutoffs} == {"en"}
    assert {r["doc_id"] for r in C.quality_rules(spark, docs, str(tmp_path)).collect()} == keep


def removed_parts(before, after):
    """Spans of ``before`` that marks in ``after`` stand for."""
    pieces = re.split("|".join(re.escape(f"[{k.upper()}]") for k in pii.KINDS), after)
    m = re.fullmatch("(.+?)".join(re.escape(p) for p in pieces), before, re.DOTALL)
    assert m, after
    return [m.span(i + 1) for i in range(len(pieces) - 1)]


def test_each_stage_against_brute_force(spark):
    docs = C.documents(spark, SF)
    columns = docs.columns

    one = C.stored(C.quality_rules(spark, docs, SF), "t1")
    assert one.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    _, keep = plain_kept([tuple(r) for r in docs.select("doc_id", "lang", "text").collect()],
                         [tuple(r) for r in labels.select("doc_id", "quality").collect()])
    assert {r["doc_id"] for r in one.collect()} == keep

    two = C.stored(C.near_duplicates(spark, one, SF), "t2")
    rows = [(r["doc_id"], shingles(r["text"])) for r in one.collect()]
    root = {d: d for d, _ in rows}
    for _ in range(3):
        for i, (d, s) in enumerate(rows):
            for e, t in rows[:i]:
                if s == t or len(s & t) >= 0.8 * len(s | t) - 1e-9:
                    root[d] = root[e] = min(root[d], root[e])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(root.values()))

    three = C.stored(C.redact_pii(spark, two, SF), "t3")
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    found = 0
    assert three.count() == len(before)
    for r in three.collect():
        gone = removed_parts(before[r["doc_id"]], r["text"])
        inside = {i for a, b in gone for i in range(a, b)}
        spans = plain_spans(before[r["doc_id"]])
        assert all(inside.issuperset(range(a, b)) for a, _, b in spans) and r["n_chars"] == len(r["text"])
        found += len(spans)
    assert found

    four = C.stored(C.mix_sources(spark, three, SF), "t4")
    sizes = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in three.collect()}
    totals, largest = {}, {}
    for source, n in sizes.values():
        totals[source] = totals.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    got = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert set(got) <= set(sizes) and max(got.values()) <= 2 and four.columns == columns
    for source, target in fill(totals).items():
        taken = sum(got.get(d, 0) * n for d, (s, n) in sizes.items() if s == source)
        assert abs(taken - target) <= largest[source] + 1e-6, source
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in four.collect())

    five = C.encode_bpe(spark, four, SF).collect()
    library = Tokenizer.from_file(bpe.tokenizer_path())
    assert len(five) == four.count()
    for r in five:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)


def test_run_is_the_stages(spark):
    out = C.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
