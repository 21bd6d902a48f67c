"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is read into leaf blocks (text between block-level tags, with the open
tags above it). Every block gets features from its ancestor tags, their class
and id words, its text and its neighbours; a two-state conditional random field
(main text or not), fitted by forward-backward gradients, labels the blocks
together, decoded by Viterbi. The text of the main blocks, in page order, is the
result.

Labelled pages: at most SAMPLE_PAGES pages (least id hash) of at most
PAGE_BLOCKS blocks that mark their article. Each is used as it is and in
altered copies, in which the marking tags are renamed to neutral containers and
menus, notices, adverts, forms, side columns and reader comments are put
between, with texts of the page's own paragraphs, so that the model learns from
all features instead of the marking tag alone.

Defined cases: null or empty html gives empty text; a page without main blocks
gives empty text; null or repeated ids keep their rows; without any labelled
page the marking rule itself decides; unclosed or stray tags, comments and
unknown references never fail; only the content of RAW elements is dropped unseen, and
an unclosed one ends with its container; extra columns are ignored; whole pages of any length.
"""

from __future__ import annotations

import html as H
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.llm.arrow import map_texts

SAMPLE_PAGES, PAGE_BLOCKS, COPIES, WIDTH, EPOCHS = 200, 1000, 6, 1 << 14, 60

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup
option p pre section select summary table tbody td template textarea tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea title".split())  # never text of the page; all else is labelled
CLOSES_P = BLOCK - frozenset("button caption legend option optgroup".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("ul ol dl table div section article main body td th blockquote form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|[^<]+|<", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_END = re.compile(r"</([A-Za-z][A-Za-z0-9:-]*)")


class Path:
    """Open tags of a block, innermost last, as a chain that blocks share: deep
    nesting costs nothing per block. ``marks``: the distinct tags with marks."""

    __slots__ = ("outer", "mark", "depth", "marks", "seen", "inside", "aside", "names")

    def __init__(self, outer: Path | None, mark: str):
        self.outer, self.mark, self.names = outer, mark, None
        self.depth = outer.depth + 1 if outer else 1
        if outer and mark in outer.seen:
            self.marks, self.seen, self.inside, self.aside = outer.marks, outer.seen, outer.inside, outer.aside
            return
        tag = mark.partition(" ")[0]
        self.marks = (*outer.marks, mark) if outer else (mark,)
        self.seen = frozenset(self.marks)
        self.inside = tag in MAIN or bool(outer and outer.inside)
        self.aside = tag in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(_words(mark)) or bool(outer and outer.aside)

    @staticmethod
    def of(marks) -> Path | None:
        path = None
        for m in marks:
            path = Path(path, m)
        return path

    def all(self) -> tuple[str, ...]:
        out, at = [], self
        while at:
            out.append(at.mark)
            at = at.outer
        return tuple(reversed(out))


def blocks(page: str) -> list[tuple[str, Path | None, bool]]:
    """Leaf blocks of a page: (text, open tags with their marks, share of link text over a half)."""
    out: list[tuple[str, Path | None, bool]] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter = Counter()  # tags on the stack
    buffer: list[str] = []
    path: Path | None = None
    linked = 0
    in_link = 0

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(H.unescape("".join(buffer)).split())
            if text:
                out.append((text, path, 2 * linked > len(text)))
            buffer.clear()
        linked = 0

    def pop_to(k: int):
        nonlocal in_link
        for tag, _ in stack[k:]:
            in_link -= tag == "a"
            opened[tag] -= 1
        del stack[k:]

    open_ended: set[str] = set()  # raw elements without a further end tag

    def after_raw(tag: str, at: int) -> int:
        """Where a raw element ends: behind its end tag, or without one at the end of its container."""
        if tag not in open_ended:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if close:
                return close.end()
            open_ended.add(tag)
        return next((m.start() for m in _END.finditer(page, at) if opened[m.group(1).lower()]), len(page))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            s = m.group()
            if s[0] != "<" or s == "<":
                if not buffer:
                    path = stack[-1][1] if stack else None
                buffer.append(s)
                if in_link:
                    linked += len(s)
            elif s.startswith("<![CDATA["):
                buffer.append(H.escape(s[9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE and tag not in BLOCK:
                    break  # an inline end tag doesn't close containers
            continue
        attrs = m.group(3) or m.group(6) or ""
        if tag in RAW and not attrs.rstrip().endswith("/"):
            if tag in BLOCK:
                flush()  # a script inside a paragraph doesn't divide it
            at = after_raw(tag, at)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and buffer:
                buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P or tag in SAME:
                closing = SAME.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closing:
                        pop_to(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        marks = " ".join(next(filter(None, g), "") for g in _MARK.findall(attrs)) if attrs else ""
        stack.append((tag, Path(stack[-1][1] if stack else None, f"{tag} {marks.lower()}" if marks else tag)))
        opened[tag] += 1
        in_link += tag == "a"
    flush()
    return out


MAIN = ("article", "main")
ASIDE_TAGS = frozenset("nav header footer aside form button fieldset menu dialog select label".split())
ASIDE_WORDS = frozenset("""ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert popup modal
nav menu navbar breadcrumb breadcrumbs header footer sidebar side aside widget related share social comment comments reply
replies respond discussion newsletter subscribe login signup search form copyright""".split())


def _words(mark: str) -> list[str]:
    return [w for w in _SPLIT.split(mark.partition(" ")[2]) if w]


def marked(block) -> bool:
    """The labelling rule: inside the page's article and in nothing that is set aside."""
    return bool(block[1]) and block[1].inside and not block[1].aside


_IDS: dict[str, int] = {}


def _id(name: str) -> int:
    if len(_IDS) > 200_000:
        _IDS.clear()
    got = _IDS.get(name)
    if got is None:
        got = _IDS[name] = zlib.crc32(name.encode()) % WIDTH
    return got


def _names(path: Path | None) -> list[str]:
    """Features of the open tags, made once for each path."""
    if path is None:
        return []
    if path.names is None:
        path.names = [x for p in path.marks for x in ("t:" + p.partition(" ")[0], *(f"c:{w}" for w in _words(p)))]
    return path.names


def _own(block) -> list[str]:
    text, path, link = block
    n = text.count(" ") + 1
    out = [f"n{min(n.bit_length(), 8)}", f"link{link}", f"end{text[-1] if text[-1] in '.!?:|…' else text[-1].isalnum()}",
           f"stop{min((text.count('. ') + text.count(', ')) * 20 // n, 4)}", f"digit{any(c.isdigit() for c in text[:200])}",
           f"first{text[0] if text[0] in '©&|»›' else text[0].isupper()}", f"depth{min(path.depth, 8) if path else 0}",
           f"top{path.mark.partition(' ')[0] if path else ''}"]
    aside = bool(path) and path.aside
    return [*out, *_names(path), f"aside{aside}", f"{aside}:{out[7]}", f"{aside}:{out[0]}:{link}"]


def features(bs: list[tuple]) -> list[list[int]]:
    """Feature numbers of every block: its own, its place and those of its neighbours."""
    own = [_own(b) for b in bs]
    n, out = len(bs), []
    for k, o in enumerate(own):
        ids = [_id(x) for x in o]
        ids.append(_id(f"place{min(3, 4 * k // n)}"))
        ids += [_id("<" + x) for x in own[k - 1][:5]] if k else [_id("<start")]
        ids += [_id(">" + x) for x in own[k + 1][:5]] if k + 1 < n else [_id(">end")]
        out.append(ids)
    return out


def altered(bs: list[tuple], labels: list[int], seed: int) -> tuple[list[tuple], list[int]]:
    """A copy of a labelled page in another layout."""
    rng = random.Random(seed)
    box = rng.choice(["div content", "div post-body", "main", "section", "div entry", "div story", "div main", "div"])
    swap = {"article": box, "main": box, "nav": rng.choice(["div menu", "div nav", "nav"]),
            "footer": rng.choice(["div footer", "div bottom", "footer"])}
    put = lambda path: tuple(swap.get(p.partition(" ")[0], p) if p.partition(" ")[0] in swap else p for p in path)
    rows = [((t, put(p.all() if p else ()), link), y) for (t, p, link), y in zip(bs, labels)]
    texts = [t for t, _, _ in bs] or ["x"]
    root = ("html", "body")
    extra = {
        "comments": (root + ("section comments", rng.choice(["div comment", "li comment", "div reply"]), "p"), False),
        "side": (root + (rng.choice(["aside", "div sidebar", "div widget"]), rng.choice(["p", "li", "div"])), False),
        "notice": (root + (rng.choice(["div cookie-notice", "div alert", "div banner", "div notice"]), rng.choice(["p", "div"])), False),
        "form": (root + ("form", rng.choice(["label", "button", "p"])), False),
        "header": (root + ("header", rng.choice(["h1", "p", "div"])), False),
        "related": (root + (rng.choice(["ul related", "div share"]), "li"), True),
        "ad": (root + (rng.choice(["div ad", "div advert", "div sponsored", "aside ad"]),), False)}
    inner = [k for k, (_, y) in enumerate(rows) if y]
    lo, hi = (inner[0], inner[-1] + 1) if inner else (0, len(rows))
    for kind in rng.sample(sorted(extra), rng.randint(1, len(extra))):
        path, link = extra[kind]
        if rng.random() < 0.5 and inner:  # set into the article itself
            path = rows[inner[0]][0][1][:3] + path[2:]
        new = [((rng.choice(texts)[:rng.choice([20, 60, 400, 5000])].strip() or "x", path, link), 0)
               for _ in range(rng.randint(1, 4))]
        where = {"header": 0, "comments": hi, "form": hi, "related": hi}.get(kind, rng.choice([0, lo, hi, rng.randint(lo, hi)]))
        rows[where:where] = new
        if where <= lo:
            lo, hi = lo + len(new), hi + len(new)
        elif where < hi:
            hi += len(new)
    return [(t, Path.of(p), link) for (t, p, link), _ in rows], [y for _, y in rows]


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> dict:
    """Weights [WIDTH, 2], transitions [2, 2] and start [2] by gradient ascent on the conditional likelihood."""
    pages = sorted(pages, key=lambda p: len(p[1]))
    flat = np.array([f for x, _ in pages for b in x for f in b], dtype=np.int64)
    count = np.array([len(b) for x, _ in pages for b in x], dtype=np.int64)
    first = np.r_[0, np.cumsum(count)[:-1]]
    y = np.array([v for _, ys in pages for v in ys], dtype=np.int64)
    size = np.array([len(ys) for _, ys in pages], dtype=np.int64)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    n, longest = len(y), int(size.max())
    owner = np.repeat(np.arange(n), count)
    w, t, s = np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(2)
    aw, at, as_ = np.full_like(w, 1e-8), np.full_like(t, 1e-8), np.full_like(s, 1e-8)
    one = np.eye(2)
    steps = [(begin[size > k] + k) for k in range(longest)]  # rows of step k, pages by length
    for _ in range(EPOCHS):
        e = np.add.reduceat(w[flat], first, axis=0)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[steps[0]] = e[steps[0]] + s
        for k in range(1, longest):
            r = steps[k]
            a[r] = e[r] + np.logaddexp.reduce(a[r - 1][:, :, None] + t, axis=1)
        for k in range(longest - 1, 0, -1):
            r = steps[k]
            b[r - 1] = np.logaddexp.reduce(t + (e[r] + b[r])[:, None, :], axis=2)
        z = np.repeat(np.logaddexp.reduce(a[begin] + b[begin], axis=1), size)
        p = np.exp(a + b - z[:, None])
        d = one[y] - p
        gw = np.zeros_like(w)
        np.add.at(gw, flat, d[owner])
        gw = gw / n - 1e-5 * w
        inner = np.concatenate(steps[1:]) if longest > 1 else np.empty(0, dtype=np.int64)
        pair = np.exp(a[inner - 1][:, :, None] + t + (e[inner] + b[inner])[:, None, :] - z[inner][:, None, None])
        gt = (one[y[inner - 1]][:, :, None] * one[y[inner]][:, None, :] - pair).sum(0) / n - 1e-4 * t
        gs = d[begin].sum(0) / n
        for x, g, acc in ((w, gw, aw), (t, gt, at), (s, gs, as_)):
            acc += g * g
            x += 0.3 * g / np.sqrt(acc)
    return {"w": w.astype(np.float32), "t": t, "s": s}


def viterbi(e: np.ndarray, t: np.ndarray, s: np.ndarray) -> list[int]:
    """Best labels of one page from emissions [blocks, 2]."""
    (t00, t01), (t10, t11) = t.tolist()
    rows = e.tolist()
    a0, a1 = rows[0][0] + s[0], rows[0][1] + s[1]
    back = []
    for e0, e1 in rows[1:]:
        f0, f1 = a0 + t00 >= a1 + t10, a0 + t01 >= a1 + t11
        back.append((0 if f0 else 1, 0 if f1 else 1))
        a0, a1 = (a0 + t00 if f0 else a1 + t10) + e0, (a0 + t01 if f1 else a1 + t11) + e1
    y = [0 if a0 >= a1 else 1]
    for b in reversed(back):
        y.append(b[y[-1]])
    return y[::-1]


def train(pages: DataFrame) -> dict | None:
    """Model from the bounded sample; executors make the features."""
    rows = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    has = F.lower("html").rlike("<(article|main)[ >]")
    ids = [r["page_id"] for r in rows.filter(has & F.col("page_id").isNotNull()).select("page_id")
           .orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]
    if not ids:
        return None

    def make():
        def work(texts):
            out = []
            for p in texts:
                bs = blocks(p)
                ys = [int(marked(b)) for b in bs]
                if not 0 < len(bs) <= PAGE_BLOCKS or not sum(ys):
                    out.append([])
                    continue
                seed = zlib.crc32(p.encode())
                copies = [(bs, ys), *(altered(bs, ys, seed + k) for k in range(COPIES))]
                out.append([{"y": y, "x": [f for f in features(b)]} for b, y in copies])
            return {"got": out}
        return work

    schema = "got array<struct<y:array<int>,x:array<array<int>>>>"
    sample = rows.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html"))  # an id may repeat
    got = sorted(map_texts(sample, "html", make, schema).collect(), key=lambda r: r["page_id"])
    got = [(c["x"], c["y"]) for r in got for c in r["got"]]
    return fit(got) if got else None


def main_texts(pages: list[str], model: dict | None) -> list[str]:
    """Main text of every page."""
    parsed = [blocks(p) for p in pages]
    if model is None:
        return ["\n".join(b[0] for b in bs if marked(b)) for bs in parsed]
    feats = [f for bs in parsed for f in features(bs)]
    if feats:
        flat = np.array([i for f in feats for i in f], dtype=np.int64)
        first = np.r_[0, np.cumsum([len(f) for f in feats])[:-1]]
        e = np.add.reduceat(model["w"][flat], first, axis=0)
    out, at = [], 0
    for bs in parsed:
        if not bs:
            out.append("")
            continue
        y = viterbi(e[at:at + len(bs)], model["t"], model["s"])
        at += len(bs)
        out.append("\n".join(b[0] for b, v in zip(bs, y) if v))
    return out


def extract(pages: DataFrame, model: dict | None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def make():
        def work(texts):
            got = main_texts(texts, model)
            return {"text": got, "n_chars": [len(t) for t in got]}
        return work

    return map_texts(pages.select("page_id", "url", "html"), "html", make, "text string, n_chars bigint")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
