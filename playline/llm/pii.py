"""Personal data: boosted candidate spans on top of base rules.

Base rules give fixed spans. High-recall generators propose further, overlapping
spans (any address around an at sign, spelt-out addresses, any digit chain, its
white-space pieces and every run of its digit groups with RUN digits); gradient-boosted trees score each from its format and its context,
Platt scaling calibrates the scores on held-out candidates, and per kind the
least threshold (LEAST or more) with PRECISION on those held-out candidates selects
redactions.
Selected spans never displace base spans: what overlaps a base span or a better
selected one is left out.

Training candidates come from at most SAMPLE_DOCS documents (least id hash) and
PER_DOC candidates of each, evenly spaced: base spans and respelt copies of them
are positive (addresses spelt out, telephone numbers without country code, also
after another number and in lists), candidates that the base rules turned down,
parts and joins of the numbers set side by side, and inserted dates, versions,
prices and references are negative.

Defined cases: null or empty text has no spans; equal texts get equal spans;
null and repeated ids keep their rows; an empty table, or a sample without both
classes, leaves the base rules alone; whole texts of any length; extra columns
pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.llm import boost
from playline.llm.arrow import map_texts
from playline.llm.common import documents, text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, PER_DOC, PRECISION, LEAST = 2000, 40, 0.98, 0.5
RUN = range(7, 20)  # digits of a telephone or card number
BLOCK = 8192  # candidates scored at a time

# The base patterns. A run that fails at its first character
# fails at the others too, so looking behind keeps the matches and saves time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Candidate generators.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({<]\s?at\s?[\])}>]\s?[A-Za-z0-9-]{1,63}"
                    r"(?:\s?(?:\.|[\[({<]\s?dot\s?[\])}>])\s?[A-Za-z0-9-]{1,63}){1,5}", re.I)
_CHAIN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9])+")
_PART = re.compile(r"\S+")
_GROUP = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9]")
_NONDIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules, in order; linear in the text."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                    if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _NONDIGIT.sub("", m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                    if 9 <= len(_NONDIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def _number(text: str, s: int, e: int, n: int) -> tuple[int, int, int]:
    """Candidate of ``n`` digits with its kind."""
    if text[s] == "+" and n <= 15:
        return s, 3, e
    return s, 1 if n <= 12 and text.count(".", s, e) == 3 else 2 if n >= 12 else 3, e


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Digit chains, their white-space pieces and their runs of groups; linear in the text."""
    for m in _CHAIN.finditer(text):
        start, end = m.span()
        if end - start < 7:
            continue
        spans = [(start, end)]
        if " " in m.group():
            spans += [p.span() for p in _PART.finditer(text, start, end)]
        own = set()
        for s, e in spans:
            if e - s <= 60:
                n = len(_NONDIGIT.sub("", text[s:e]))
                if 4 <= n <= 40 and (s, e) not in own:
                    own.add((s, e))
                    yield _number(text, s, e, n)
        groups = [g.span() for g in _GROUP.finditer(text, start, end)]
        for i, (s, _) in enumerate(groups):
            while s > start and text[s - 1] in "+(":
                s -= 1
            n = 0
            for gs, ge in groups[i:i + RUN.stop]:
                n += ge - gs
                if n >= RUN.stop:
                    break
                if n in RUN and (s, ge) not in own:
                    yield _number(text, s, ge, n)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """Overlapping proposals (start, kind index, end), each once."""
    out = set()
    at = text.find("@")
    while at >= 0:
        start = at
        while start > max(0, at - 64) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1)
        if m and start < at:
            out.add((start, 0, m.end()))
        at = text.find("@", at + 1)
    if "at" in text or "AT" in text:
        if any(c in text for c in "[({<"):
            out.update((m.start(), 0, m.end()) for m in _SPELT.finditer(text))
    yield from sorted(out)
    if _DIGITS.search(text):
        yield from _numbers(text)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """The proposals in order."""
    return sorted(proposals(text))


FEATURES = 24
_CONTEXT = (re.compile(r"mail|contact|write|@", re.I), re.compile(r"tel|phone|call|fax|mobil|cell", re.I),
            re.compile(r"card|visa|pay|account|credit", re.I), re.compile(r"\bip\b|host|address|server", re.I),
            re.compile(r"version|date|isbn|order|price|ref|no\.|#|\$|€|v\Z", re.I))


_BEFORE, _AFTER = re.compile(r"([0-9]{1,20})[\x20().\-/+]{1,3}\Z"), re.compile(r"[\x20().\-/+]{1,3}([0-9]{1,20})")


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format of the span and what stands around it."""
    s, k, e = span
    piece, left, right = text[s:e], text[max(0, s - 24):s], text[e:e + 12]
    digits = _NONDIGIT.sub("", piece)
    groups = re.findall(r"[0-9]+", piece)
    short = [len(g) for g in groups] or [0]
    before, after = _BEFORE.search(left), _AFTER.match(right)  # another number beside the span
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return [k, len(piece), len(digits), sum(c.isalpha() for c in piece), piece.count("."), piece.count("-"),
            piece.count(" "), piece.count("(") + piece.count("/"), piece.startswith("+"), "@" in piece,
            "at" in piece.lower() and "@" not in piece, luhn(digits) if len(digits) >= 12 else False, octets,
            len(groups), min(short), max(short), short[0], short[-1],
            left[-1:].isalnum() or left[-1:] in ("-", ".", "/", "_"), right[:1].isalnum() or right[:1] in ("-", "/", "_"),
            len(before[1]) if before else 0, len(after[1]) if after else 0,
            len(digits) / len(piece), sum(b << i for i, b in enumerate(bool(c.search(left)) for c in _CONTEXT))]


def _respelt(piece: str, kind: int, n: int) -> str | None:
    """Another spelling of a base span, by turn ``n``."""
    if kind == 0:
        user, _, host = piece.partition("@")
        at, dot = (("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("{at}", "."))[n % 4]
        return user + at + host.replace(".", dot)
    if kind == 3:
        d = _NONDIGIT.sub("", piece)[-10:]
        return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}",
                f"{d[:3]} {d[3:6]} {d[6:]}")[n % 4]
    return None


def _decoy(n: int) -> str:
    """Strings of digits that are no personal data, by turn ``n``."""
    y, m, d = 1950 + n % 90, 1 + n % 12, 1 + n % 28
    return (f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"version {n % 9}.{m}.{d}", f"{y}-{y + 7}",
            f"{n * 7919 % 900000000 + 100000000}", f"{m},{n % 1000:03d},{d:03d}.{n % 100:02d}",
            f"ISBN 978-{n % 10}-{n % 97:02d}-{n * 31 % 1000000:06d}-{n % 7}", f"{d:02d}.{m:02d}.{y}",
            f"{n % 9}.{m}.{d}.{n % 3000 + 256}", f"{n * 104729 % 10 ** 13 + 10 ** 13}")[n % 10]


def _beside(piece: str, n: int) -> tuple[str, list[tuple[int, int]]]:
    """A telephone number after another number and in a list, by turn ``n``: text and the spans in it."""
    lead = ("", f"{2 + n % 8} ", f"{10 + n * 7 % 90} ", f"{100 + n * 31 % 900} ")[n // 4 % 4]
    digits = _NONDIGIT.sub("", piece)[:-4]
    numbers = [_respelt(digits + f"{(n * 7919 + 2711 * j) % 10000:04d}", 3, n) for j in range(1 + n // 2 % 3)]
    out, spans = lead, []
    for x in numbers:
        out += (" " if n % 5 else "/") if spans else ""
        spans.append((len(out), len(out) + len(x)))
        out += x
    return out, spans


def examples(text: str, turn: int) -> list[tuple[list[float], int]]:
    """Labelled candidates of one document, its respelt copy and its decoys."""
    base = base_spans(text)
    known = {(s, e) for s, _, e in base}
    out = []
    total = sum(1 for _ in proposals(text))
    for c in islice(proposals(text), 0, None, max(1, -(-total // PER_DOC))):
        inside = any(s < c[2] and c[0] < e for s, _, e in base)
        if (c[0], c[2]) in known or not inside:  # parts of base spans say nothing
            out.append((features(text, c), int((c[0], c[2]) in known)))
    for n, (s, k, e) in enumerate(base[:PER_DOC]):
        new = _respelt(text[s:e], k, turn + n)
        if new:
            t = text[max(0, s - 80):s] + new + text[e:e + 40]
            at = min(s, 80)
            out += [(features(t, c), 1) for c in candidates(t) if (c[0], c[2]) == (at, at + len(new))]
        if k == 3:
            new, spans = _beside(text[s:e], turn + n)
            left = text[max(0, s - 80):s]
            t, at = left + new + text[e:e + 40], len(left)
            right = {(at + a, at + b) for a, b in spans}
            out += [(features(t, c), int((c[0], c[2]) in right)) for c in candidates(t)
                    if c[0] < at + len(new) and c[2] > at]
    words = text[:4000].split(" ")
    if len(words) > 4:
        for n in range(3):
            k = 1 + (turn + 7 * n) % (len(words) - 1)
            left, new = " ".join(words[max(0, k - 8):k]) + " ", _decoy(turn * 3 + n)
            t = left + new + " " + " ".join(words[k:k + 6])
            out += [(features(t, c), 0) for c in candidates(t)
                    if c[0] >= len(left) and c[2] <= len(left) + len(new)]
    return out


def train(docs: DataFrame) -> dict | None:
    """Model, calibration and thresholds from the bounded sample; None without both classes."""
    rows = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", text_of().alias("text"))
    ids = rows.filter(F.col("text").rlike("[@0-9]")).select("h", "doc_id").orderBy("h", "doc_id").limit(SAMPLE_DOCS)
    chosen = [r["doc_id"] for r in ids.collect()]
    if not chosen:
        return None
    hit = F.col("doc_id").isin([c for c in chosen if c is not None])

    def make():
        def work(texts):
            got = [examples(t, int(hashlib.md5(t.encode()).hexdigest()[:6], 16)) for t in texts]
            return {"x": [[float(v) for f, _ in g for v in f] for g in got], "y": [[y for _, y in g] for g in got]}
        return work

    sample = rows.filter(hit).groupBy("doc_id").agg(F.min("text").alias("text"))  # an id may repeat without bound
    got = map_texts(sample, "text", make, "x array<double>, y array<int>").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    x = np.array([v for r in got for v in r["x"]]).reshape(-1, FEATURES)
    y = np.array([v for r in got for v in r["y"]], dtype=np.float64)
    held = np.repeat([hash_fold(r["doc_id"]) for r in got], [len(r["y"]) for r in got]).astype(bool)
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        return None
    model = boost.fit(x[~held], y[~held])
    s = boost.margin(model, x[held])
    a, b = boost.calibrate(s, y[held])
    p, yh, kh = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))), y[held], x[held][:, 0]
    cut = []
    for k in range(len(KINDS)):
        pk, yk = p[kh == k], yh[kh == k]
        best = 2.0  # a kind without enough evidence selects nothing
        for t in sorted(set(pk[yk > 0].tolist()), reverse=True):
            if t >= LEAST and yk[pk >= t].mean() >= PRECISION:
                # halfway to the next lower held-out score
                best = max(LEAST, (t + max(pk[pk < t], default=0.0)) / 2)
        cut.append(best)
    return {"trees": model, "a": a, "b": b, "cut": cut}


def hash_fold(doc_id: int) -> bool:
    return hashlib.md5(str(doc_id).encode()).digest()[0] % 3 == 0


def find(texts: list[str], model: dict | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    good: list[list[tuple]] = [[] for _ in texts]
    taken = [_cover(t, b) for t, b in zip(texts, base)]
    free = ((i, c) for i, t in enumerate(texts) for c in proposals(t) if taken[i].find(1, c[0], c[2]) < 0)
    while block := list(islice(free, BLOCK)):
        x = np.array([features(texts[i], c) for i, c in block], dtype=np.float64)
        p = 1 / (1 + np.exp(-np.clip(model["a"] * boost.margin(model["trees"], x) + model["b"], -30, 30)))
        for (i, c), v in zip(block, p.tolist()):
            if v >= model["cut"][c[1]]:
                good[i].append((-v, c[0] - c[2], c))  # the longer of equally good ones
    out = []
    for b, cs, mask in zip(base, good, taken):
        spans = list(b)
        for _, _, c in sorted(cs):
            if mask.find(1, c[0], c[2]) < 0:
                mask[c[0]:c[2]] = b"\1" * (c[2] - c[0])
                spans.append(c)
        out.append((b, sorted(spans)))
    return out


def _cover(text: str, spans: list[tuple[int, int, int]]) -> bytearray:
    """One byte a character, 1 inside the spans."""
    out = bytearray(len(text))
    for s, _, e in spans:
        out[s:e] = b"\1" * (e - s)
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, model: dict | None) -> DataFrame:
    def make():
        def work(texts):
            got = find(texts, model)
            out = {f"n_{name}": [sum(x[1] == k for x in b) for b, _ in got] for k, name in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in got]
            out["spans"] = [digest(a) for _, a in got]
            return out
        return work

    return map_texts(docs, "text", make, ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return detect(docs.select("doc_id", "text"), train(docs))


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, k, e in spans:
        if e <= at:
            continue  # inside what is masked already
        out += [text[at:max(s, at)], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, with every span of ``text`` replaced by its kind in brackets; null stays null."""
    model = train(docs)

    def make():
        return lambda texts: {"masked": [_masked(t, a) for t, (_, a) in zip(texts, find(texts, model))]}

    rest = [c for c in docs.columns if c != "text"]
    out = map_texts(docs.select(F.struct(*rest).alias("_doc"), F.col("text").isNull().alias("_null"), "text"),
                    "text", make, "masked string")
    text = F.when(~F.col("_null"), F.col("masked")).alias("text")
    return out.select(*[text if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
