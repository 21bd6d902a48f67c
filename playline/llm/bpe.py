"""Byte-level BPE: batched numpy merge rounds.

The words that a task has not met yet lie in one flat symbol array. A round
takes the lowest-ranked pair of every unfinished word (ranks come from a binary
search over the sorted pair keys), merges all its non-overlapping occurrences
from the left, compacts the array and looks up only the pairs that changed.
Words without a known pair leave the array. A bounded cache keeps the ids of
words between batches.

Defined cases: null or empty text has no tokens and decodes to the empty text;
added tokens of the file found in a text become their own id, as the
tokenizers library does by default; repeated rows and null ids keep their rows;
whole texts of any length; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from playline.llm.arrow import map_texts
from playline.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 150_000
NO_RANK = np.int32(2**31 - 1)
# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _printable() -> dict[int, str]:
    """Byte -> character of the byte-level alphabet."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def load(path: str) -> dict:
    """Tables of a byte-level BPE file: pair keys in order, their ranks and merged ids, bytes of ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *added.values()]) + 1
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    back = {c: b for b, c in _printable().items()}
    raw: list[bytes] = [b""] * size
    for token, i in vocab.items():
        raw[i] = bytes(back[c] for c in token)
    for token, i in added.items():
        raw[i] = token.encode()
    return {"size": size, "keys": keys[order], "rank": order.astype(np.int32), "merged": merged[order],
            "byte_id": np.array([vocab[c] for _, c in sorted(_printable().items())], dtype=np.int32),
            "added": added, "raw": raw}


def merge_words(words: list[bytes], t: dict) -> list[bytes]:
    """Ids of each word (non-empty bytes), as little-endian unsigned 32-bit integers."""
    n = len(words)
    out: list[bytes] = [b""] * n
    if not n:
        return out
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    sym = t["byte_id"][np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(n), lengths)

    def look(a, b):
        key = a.astype(np.int64) * t["size"] + b
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][at] == key
        return np.where(hit, t["rank"][at], NO_RANK), at

    # rank and table row of the pair (i, i + 1); none across words or at the end
    rank = np.full(len(sym), NO_RANK, dtype=np.int32)
    row = np.zeros(len(sym), dtype=np.int64)
    inside = np.flatnonzero(word[:-1] == word[1:])
    rank[inside], row[inside] = look(sym[inside], sym[inside + 1])
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, first)
        ended = least == NO_RANK
        size = np.diff(np.r_[first, len(sym)])
        if ended.any():
            done = np.repeat(ended, size)
            data = sym[done].astype("<u4").tobytes()
            ends = np.cumsum(size[ended]) * 4
            begin = 0
            for w, end in zip(word[first[ended]].tolist(), ends.tolist()):
                out[w] = data[begin:end]
                begin = end
            live = ~done
            sym, word, rank, row = sym[live], word[live], rank[live], row[live]
            least, size = least[~ended], size[~ended]
            if not len(sym):
                break
        take = rank == np.repeat(least, size)
        # of overlapping equal pairs (a a a) only every second counts, from the left
        hit = np.flatnonzero(take)
        start = np.r_[True, np.diff(hit) != 1]
        index = np.arange(len(hit))
        hit = hit[(index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0]
        sym[hit] = t["merged"][row[hit]]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        now = (np.cumsum(keep) - 1)[hit]
        sym, word, rank, row = sym[keep], word[keep], rank[keep], row[keep]
        # only pairs that touch a merged symbol have changed
        touched = np.union1d(now, now[now > 0] - 1)
        ok = touched < len(sym) - 1
        rank[touched[~ok]] = NO_RANK
        touched = touched[ok]
        same = word[touched] == word[touched + 1]
        rank[touched[~same]] = NO_RANK
        touched = touched[same]
        rank[touched], row[touched] = look(sym[touched], sym[touched + 1])
    return out


class Encoder:
    """Words are cut by the pattern, merged in batches and cached up to CACHE_WORDS."""

    def __init__(self, tables: dict):
        import regex

        self.t, self.cache = tables, {}
        self.cut = regex.compile(PATTERN).findall
        added = sorted(tables["added"], key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else None

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(a in text for a in self.t["added"]):
            return self.cut(text)
        out = []
        for k, part in enumerate(self.split(text)):
            out += [part] if k % 2 else self.cut(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if not self.cache:
            self.cache.update({a: np.array([i], dtype="<u4").tobytes() for a, i in self.t["added"].items()})
        cut = [self.pieces(x) for x in texts]
        new = list(set().union(*cut).difference(self.cache))
        self.cache.update(zip(new, merge_words([w.encode() for w in new], self.t)))
        return [b"".join(map(self.cache.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        raw = self.t["raw"]
        return b"".join([raw[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def tokens(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Every row with its columns but ``text``, and n_tokens, the digests and (unless switched off) the ids."""
    tables = load(path)

    def make():
        enc = Encoder(tables)

        def work(texts):
            ids = enc.encode(texts)
            out = {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [_sha(x) for x in ids],
                   "decoded_sha256": [_sha(enc.decode(x).encode()) for x in ids]}
            if with_ids:
                out["ids"] = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
            return out

        return work

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, "text", make, schema + (", ids array<int>" if with_ids else ""))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path(), with_ids=False)
