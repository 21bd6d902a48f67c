from playline.llm import pages as P

MARKED = """<!DOCTYPE html><html><head><title>t {i}</title><style>p{{x:1}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy it now {i}</div>
<article><h1>Title number {i}</h1><p><b>First part {i}, of some length &amp; with a sense.<br><p>Second part &lt;here&gt;,
with   more words, and a full stop. And again.</p></article><footer>&copy; site {i}</footer></body></html>"""
FREE = """<body><header><h1>Site</h1></header><div class="menu"><ul><li><a href=x>Home</a></li></ul></div>
<div class="cookie-notice"><p>We use cookies, please accept them.</p></div><div class="content"><h1>Title of it</h1>
<p>First paragraph is here, with some words that make sense. And more.</p><div class="ad">Buy now cheap things</div>
<p>Second paragraph follows, as it should, with more words &amp; things.</p></div><section class="comments"><h2>Comments</h2>
<div class="comment"><p>Nice article, I liked it very much. Thanks.</p></div></section><form><label>Name</label></form>
<aside>See also</aside><footer>(c) me</footer></body>"""
SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def pages(spark, n=40):
    rows = [(i, f"u{i}", MARKED.format(i=i), "clash", 1) for i in range(n)]
    rows += [(None, None, None, None, None), (100, "u", "", None, None), (101, "u", FREE, None, None), (0, "u0", MARKED.format(i=0), None, None),
             (102, "u", "<article><p>" + "long text, ".join(["x"] * 20000) + "</p></article>", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_main_text(spark):
    docs = pages(spark)
    got = P.extract(docs, P.train(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] is not None and r["page_id"] < 100:
            i = r["page_id"]
            assert r["text"] == (f"Title number {i}\nFirst part {i}, of some length & with a sense.\n"
                                 "Second part <here>, with more words, and a full stop. And again.")
    by = {r["page_id"]: r["text"] for r in got}
    assert by[None] == "" and by[100] == ""
    assert by[101] == ("Title of it\nFirst paragraph is here, with some words that make sense. And more.\n"
                       "Second paragraph follows, as it should, with more words & things.")
    assert len(by[102]) > 200_000
    assert P.extract(docs.limit(0), None).count() == 0 and P.train(docs.limit(0)) is None


def test_blocks_of_broken_pages():
    text = lambda page: [b[0] for b in P.blocks(page)]
    assert text("<p>a<b>c<br>d<p>x &lt;y&gt; <script>if(a<b)</script>z<li>q<li>r</ul>t < u") == ["ac d", "x <y> z", "q", "r", "t < u"]
    assert text("<!-- <p>no --><p>yes<!-- open") == ["yes"]
    assert text("<div title=\"a>b\">in</div><a href='x>y'>l</a>") == ["in", "l"]
    assert text("</p></div>&bogus; &#233;&eacute; <") == ["&bogus; éé <"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert text("<style>p</style" + "<" * 1000) == []


def test_only_raw_elements_are_dropped(spark):
    text = lambda page: [b[0] for b in P.blocks(page)]
    assert text("<p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds</p>") == ["so a=b holds"]
    assert text("<div><object data=x><p>in place of it</p></object><svg><text>label</text><path d='z'/></svg></div>") == ["in place of it", "label"]
    assert text("<noscript><p>n</p></noscript><template><p>t</p></template><iframe src=x>f</iframe>") == ["n", "t", "f"]
    assert text("<select><option>one<option>two</select><textarea><p>no</textarea><p>yes") == ["one", "two", "yes"]
    for tag in ("svg", "object", "select", "math", "noscript", "template", "iframe"):
        assert text(f"<article><div><{tag}></div><p>kept</p></article>") == ["kept"], tag
    for tag in ("script", "style", "textarea", "title"):
        assert text(f"<article><div><{tag}>lost</div><p>kept</p></article>") == ["kept"], tag
    assert len(text("<div><script>x</div><div><style>y</div><p>z</p>" * 20_000)) == 20_000
    docs = pages(spark)
    page = MARKED.format(i=7).replace("of some length", "of <svg><object>some length")
    assert P.main_texts([page], P.train(docs)) == P.main_texts([MARKED.format(i=7)], P.train(docs))


def test_without_labelled_pages_the_rule_decides():
    assert P.main_texts([FREE, MARKED.format(i=1)], None)[0] == ""
    assert P.main_texts([MARKED.format(i=1)], None)[0].startswith("Title number 1")


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(50):
        e, t, s = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        score = lambda y: s[y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
        assert tuple(P.viterbi(e, t, s)) == max(itertools.product((0, 1), repeat=6), key=score)


def test_nested_tags_take_time_in_proportion():
    import time

    for page in ("<div>x" * 170_000, "<div class='a b'>x</div></section>" * 30_000, "<ul><li>" * 60_000 + "x", "<p>x<i>" * 140_000):
        a = time.process_time()
        bs = P.blocks(page)
        P.features(bs)
        assert time.process_time() - a < 8 and bs


def test_paths_are_shared_and_whole():
    bs = P.blocks("<html><body><div class='Nav x'><p>a</p></div><article><p>b<p>c</article></body></html>")
    assert [(t, p.all()) for t, p, _ in bs] == [
        ("a", ("html", "body", "div nav x", "p")), ("b", ("html", "body", "article", "p")), ("c", ("html", "body", "article", "p"))]
    assert [P.marked(b) for b in bs] == [False, True, True] and P.Path.of(bs[0][1].all()).marks == bs[0][1].marks
