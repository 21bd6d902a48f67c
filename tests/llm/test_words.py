import random
import re

import numpy as np

from playline.llm import words as W


def test_words_and_hashes(monkeypatch):
    rng = random.Random(2)
    parts = ["a", "b", "ab", "ba", "é", "日本", "\x85", "\xa0", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "longer"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)] + ["", " ", "x" * 70000, "y " * 3000]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    for segment in (1 << 21, 100):
        monkeypatch.setattr(W, "SEGMENT", segment)
        h, n = W.word_hashes([t.encode() for t in texts])
        assert n.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        by_word = {}
        for word, value in zip(flat, zip(*h.tolist())):
            assert by_word.setdefault(word, value) == value
        assert all(len({v[k] for v in by_word.values()}) == len(by_word) for k in (0, 1))
    h, n = W.word_hashes([])
    assert h.shape == (2, 0) and len(n) == 0


def test_no_collisions_among_permutations():
    import itertools

    ws = ["".join(p) for k in range(1, 8) for p in itertools.permutations("abcdefg", k)]
    h, _ = W.word_hashes([" ".join(ws).encode()])
    assert [len(np.unique(x)) for x in h] == [len(ws)] * 2


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def test_thue_morse_words_differ():
    """Their polynomials modulo 2 ** 64 are equal, whatever the base and the values of the letters."""
    ws = [thue_morse(n, a, b) for n in (8, 16, 32, 64, 1024, 2048, 4096, 8192) for a, b in ("ab", "ba", "xy", "yx")]
    h, _ = W.word_hashes([" ".join(ws).encode()])
    assert [len(np.unique(x)) for x in h] == [len(ws)] * 2


def test_words_of_every_length_and_change_of_a_byte():
    rng = random.Random(5)
    ws = ["".join(rng.choices("ab\0", k=n)) for n in range(1, 70) for _ in range(20)]
    ws += [w[:k] + "c" + w[k + 1:] for w in ws[::7] for k in range(len(w))]
    ws = list(dict.fromkeys(ws))
    h, _ = W.word_hashes([" ".join(ws).encode()])
    assert [len(np.unique(x)) for x in h] == [len(ws)] * 2
    alone, _ = W.word_hashes([w.encode() for w in ws])
    assert (alone == h).all()


def test_windows_depend_on_order():
    h, _ = W.word_hashes([b"a b c a c b"])
    for k in (0, 1):
        assert len(np.unique(W.windows(h[k], 3, k))) == 4 and len(W.windows(h[k], 7, k)) == 0


def test_window_hashes_of_thue_morse_texts_differ():
    h, n = W.word_hashes([" ".join(thue_morse(64)).encode(), " ".join(thue_morse(64, "b", "a")).encode()])
    for k in (0, 1):
        for width in (5, 13, 64):
            texts = {}
            for t, word in ((0, thue_morse(64)), (1, thue_morse(64, "b", "a"))):
                for i, x in enumerate(W.windows(h[k][64 * t:64 * t + 64], width, k).tolist()):
                    assert texts.setdefault(x, word[i:i + width]) == word[i:i + width]
            assert len(set(texts.values())) == len(texts)
        assert W.few(h[k][:4], k)[0] != W.windows(h[k][:4], 4, k)[0]
