"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one logistic classifier over hashed byte
n-grams (1 to 4 bytes of the lower-cased letters, counts scaled to unit length)
predicts each bit. Decoding is loss-weighted: the language whose codeword has the
least total logistic loss against the bit margins wins, and the score is the
softmax share of that loss, so two near codewords show as a low score
(``ambiguous`` below a margin).

Training uses at most PER_LANGUAGE documents of each language (least hash of the
id first), and only texts and languages of documents outside the held-out fold
crc32(id) mod 4 = 2. Every document is predicted from its whole text alone.

Defined cases: null text or a text without a letter is ``und`` with score 0;
null ids belong to no fold (not held out, never trained on); null langs never
train; with no training language at all everything is ``und``; with one, every
text with a letter gets it; repeated rows are predicted alike; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playline.llm.arrow import map_texts
from playline.llm.common import documents, stored, text_of

PER_LANGUAGE = 500      # bound of the training sample
LANGUAGES = 256         # bound of the model: the most frequent languages are learned, rarer ones never predicted
BITS_PER_LANGUAGE, LEAST_BITS = 2, 15
WIDTH = 1 << 13         # hashed features
ROUNDS, RATE, DECAY = 300, 4.0, 1e-5
AMBIGUOUS = 0.2


def _has_letter():
    import regex

    return regex.compile(r"\p{L}").search


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every n-gram; white space runs and non-letters count as one space."""
    import regex

    clean = regex.compile(r"[^\p{L}\p{M}]+").sub
    raw = [(" " + clean(" ", t).lower().strip() + " ").encode() for t in texts]
    n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), n)
    feats, docs = [], []
    h = np.zeros(len(data), dtype=np.uint32)
    for k in range(4):
        if len(data) <= k:
            break
        # h[i] covers data[i : i + k + 1]
        h = h[:len(data) - k] * np.uint32(0x01000193) + data[k:] + np.uint32(1)
        inside = doc[:len(h)] == doc[k:]
        x = h * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
        feats.append((x >> np.uint32(19))[inside].astype(np.int32))
        docs.append(doc[:len(h)][inside])
    return np.concatenate(feats), np.concatenate(docs)


def _counts(texts: list[str]) -> np.ndarray:
    """Unit-length feature vectors, float32 [texts, WIDTH]."""
    f, d = _grams(texts)
    x = np.bincount(d.astype(np.int64) * WIDTH + f, minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH)
    x = np.sqrt(x.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords in {-1, 1} with a large least distance (best of many draws)."""
    bits = max(LEAST_BITS, int(np.ceil(BITS_PER_LANGUAGE * 5 * np.log2(max(n, 2)))))
    rng, best = np.random.default_rng(seed), None
    for _ in range(200 if n <= 64 else 10):
        c = rng.choice([-1.0, 1.0], size=(n, bits)).astype(np.float32)
        near = (c @ c.T - 2 * bits * np.eye(n, dtype=np.float32)).max() if n > 1 else 0
        split = np.abs(c.sum(0)).max() if n > 1 else 0
        if (best is None or (near, split) < best[0]) and (n == 1 or split < n):
            best = ((near, split), c)
    return best[1] if best is not None else rng.choice([-1.0, 1.0], size=(n, bits)).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> dict:
    """One logistic regression per bit by full-batch gradient descent with momentum."""
    code = codebook(len(langs))
    target = code[y]                                    # [rows, bits]
    weight = (1.0 / np.bincount(y, minlength=len(langs)))[y].astype(np.float32)
    weight /= weight.sum()
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    b = np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(ROUNDS):
        m = np.clip((x @ w + b) * target, -30, 30)
        g = -(target / (1 + np.exp(m))) * weight[:, None]
        vw = 0.9 * vw - RATE * (x.T @ g + DECAY * w)
        vb = 0.9 * vb - 0.1 * RATE * g.sum(0)
        w, b = w + vw, b + vb
    return {"langs": langs, "code": code, "w": w, "b": b}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner and score in [0, 1] of every row of bit margins."""
    loss = np.stack([np.logaddexp(0, -margins * c).sum(1) for c in code], axis=1)
    e = np.exp(loss.min(1, keepdims=True) - loss)
    p = e / e.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


def train(docs: DataFrame) -> dict | None:
    """Model from the bounded sample; feature vectors (WIDTH floats each) are made by the executors."""
    rows = (docs.select("doc_id", "lang", text_of().alias("text"))
            .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                    & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)))
    ids = stored(rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")), "language-ids")
    top = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not top:
        return None
    # the least hashes of a language lie below a bound that its count gives: no task ranks a whole language
    bound = {r["lang"]: min(2 ** 63 - 1, int(-2 ** 63 + 2 ** 64 * 4 * PER_LANGUAGE / r["count"])) for r in top}
    least = F.create_map(*[x for lang, b in bound.items() for x in (F.lit(lang), F.lit(b))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    pick = ids.filter(F.col("h") <= least[F.col("lang")]).withColumn("n", rank).filter(F.col("n") <= PER_LANGUAGE)
    chosen = pick.agg(F.collect_set("doc_id")).first()[0]  # at most LANGUAGES * PER_LANGUAGE ids

    def vectors(texts):
        ok = _has_letter()
        x = _counts(texts)
        return {"x": [v.astype(np.float16).tobytes() if ok(t) else None for v, t in zip(x, texts)]}

    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long"))
    # an id may repeat without bound: one text of each id and language
    texts = rows.join(ids, "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = (map_texts(texts, "text", lambda: vectors, "x binary").filter("x IS NOT NULL").collect())
    sample.sort(key=lambda r: (r["doc_id"], r["lang"]))
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in sample]).astype(np.float32)
    y = np.array([langs.index(r["lang"]) for r in sample])
    return fit(x, y, langs)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for the whole text of every row."""

    def make():
        ok = _has_letter()

        def work(texts):
            some = np.array([bool(ok(t)) for t in texts]) if model else np.zeros(len(texts), dtype=bool)
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            at = np.flatnonzero(some)
            for i in range(0, len(at), 256):
                part = at[i:i + 256]
                best, p = decode(_counts([texts[k] for k in part]) @ model["w"] + model["b"], model["code"])
                lang[part], score[part] = [model["langs"][k] for k in best], p
            return {"lang_pred": lang.tolist(), "score": score.tolist(),
                    "ambiguous": (some & (score < 1 - AMBIGUOUS)).tolist()}

        return work

    return map_texts(docs, "text", make, "lang_pred string, score double, ambiguous boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), train(docs))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
