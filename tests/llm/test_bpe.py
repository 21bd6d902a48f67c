import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playline.llm import bpe
from tests.llm.helpers import awkward, empty, row

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "aaa", "'s", "'", "''", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "é", "ñ", "日本", "🙂", "1", "23",
         "²", "!", "<|endoftext|>", "<|end", "'ll", "'LL", "́", "\x00", "the", "The", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library):
    rng = random.Random(8)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000, "", " "]
    enc = bpe.Encoder(bpe.load(PATH))
    for t, ids, want in zip(texts, enc.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == want.ids, t
        assert enc.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == t


def test_small_cache_changes_nothing(monkeypatch):
    texts = ["one two three", "two three four", "five"] * 3
    want = bpe.Encoder(bpe.load(PATH)).encode(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    enc = bpe.Encoder(bpe.load(PATH))
    assert [x for t in texts for x in enc.encode([t])] == want


def test_awkward_rows(spark, library):
    docs = awkward(spark, [row(50, "a <|endoftext|> b")])
    got = bpe.tokens(docs.select("doc_id", "text"), PATH).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        if r["doc_id"] not in (None, 2):
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids"] == ids
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.tokens(empty(spark).select("doc_id", "text"), PATH).count() == 0
