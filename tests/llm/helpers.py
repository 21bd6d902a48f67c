"""Small inputs with the awkward rows that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _doc int, kept string"
WORDS = [f"w{i}" for i in range(300)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text is not None else None, "x", 7, "y")


def awkward(spark, extra=()):
    """Null and repeated ids, null and empty texts, null lang and source, a very long text, clashing columns."""
    base = prose(1, 120)
    rows = [row(1, base), row(2, base), row(2, base), row(2, prose(3, 60)), row(None, base), row(None, None),
            row(5, None), row(6, ""), row(7, " \n\t "), row(8, "one two"), row(9, prose(4, 20000), None, None),
            row(10, "é🙂 ñ\x85x 日本", "fr", "é"), *extra]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
