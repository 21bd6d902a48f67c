import hashlib
import random
from collections import Counter

import pytest

from playline.llm import alignment as A, bpe
from tests.llm.helpers import awkward, empty, prose, row


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.tokenizer_path(A.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path(A.B_FILE))
    alphabet = {c: k for k, c in bpe._printable().items()}
    a_bytes = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids, a_bytes), (lambda t: b.encode(t), b_bytes)


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(of(i))))
        at = out[-1][2]
    return out


def brute(rows, sides):
    (enc_a, by_a), (enc_b, by_b) = sides
    docs, counts = [], Counter()
    for i, t in rows:
        a, b = (enc_a(t), enc_b(t)) if t else ([], [])
        if t and not b"".join(map(by_a, a)) == b"".join(map(by_b, b)) == (" " + t).encode():
            a, b = [], []
        a, b = spans(a, by_a), spans(b, by_b)
        pairs = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(pairs)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        text = ";".join(",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(y[0]) for y in b if lo < y[2] <= hi)
                        for lo, hi in zip([0, *cuts], cuts))
        docs.append((i, len(a), len(b), len(cuts), pairs, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((i, na, nb, g, len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p), s)
                   for i, na, nb, g, p, s in docs), key=str)


def corpus(spark):
    rng = random.Random(2)
    pool = ["naïve", "日本語テキスト", "🙂🙃", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "def f(x):", "  ", "\n\n", "\t", "'ll", "12345", "ﬁ", "é", "\x85"]
    rows = [row(100 + k, " ".join([prose(k, 5), *rng.choices(pool, k=rng.randint(1, 8))])) for k in range(60)]
    rows += [row(300, "a▁b"), row(301, "a" * 3000), row(302, " lead"), row(303, "trail  "), row(304, "\x00\x01"), row(305, "x" + " " * 50 + "y")]
    return awkward(spark, rows).filter("doc_id IS NULL OR doc_id <> 9")


@pytest.mark.parametrize("pairs", [A.PAIRS, 200])
def test_matches_brute_force(spark, sides, pairs, monkeypatch):
    monkeypatch.setattr(A, "CHUNK_TOKENS", 500)
    docs = corpus(spark)
    out = A.align(docs, bpe.tokenizer_path(A.A_FILE), bpe.tokenizer_path(A.B_FILE), pairs)
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], sides)


def test_ids_come_back(spark, sides):
    import numpy as np

    out = A.align(spark.createDataFrame([(1, "some plain text")], "doc_id long, text string"), bpe.tokenizer_path(A.A_FILE), bpe.tokenizer_path(A.B_FILE)).first()
    assert np.frombuffer(out["a_ids"], "<u2").tolist() == sides[0][0]("some plain text")
    assert np.frombuffer(out["b_ids"], "<u2").tolist() == sides[1][0]("some plain text")


def test_long_text_has_whole_links(spark, sides):
    docs = spark.createDataFrame([(9, prose(4, 20000))], "doc_id long, text string")
    r = A.align(docs, bpe.tokenizer_path(A.A_FILE), bpe.tokenizer_path(A.B_FILE)).first()
    assert r["n_a"] == len(sides[0][0](prose(4, 20000))) and max(r["n_a"], r["n_b"]) <= r["n_links"] < r["n_a"] + r["n_b"]


def test_empty(spark):
    assert A.align(empty(spark), bpe.tokenizer_path(A.A_FILE), bpe.tokenizer_path(A.B_FILE)).count() == 0
