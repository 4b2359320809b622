"""Page trees and what is read from them, against plain versions over generated pages."""

from __future__ import annotations

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import dom as D

INLINE, BLOCK, LAX = ["b", "span", "a"], ["p", "div", "section", "blockquote", "article", "h1", "h2", "h4", "ul", "table", "td"], {"p", "li", "tr", "td"}


class Made:
    """A generated element: its tag, attributes and children (elements or words)."""

    def __init__(self, tag, attrs=None, children=()):
        self.tag, self.attrs, self.children = tag, attrs or {}, list(children)

    def html(self, r, lax):
        inner = "".join(c.html(r, lax) if isinstance(c, Made) else f" {c} " for c in self.children)
        end = "" if self.tag in ("img", "br") or (lax and self.tag in LAX and r.random() < 0.5) else f"</{self.tag}>"
        return f"<{self.tag}{''.join(f' {k}="{v}"' for k, v in self.attrs.items())}>{inner}{end}"

    def words(self, hidden=("script", "style", "noscript", "template")):
        if self.tag in hidden:
            return []
        return [w for c in self.children for w in (c.words(hidden) if isinstance(c, Made) else [c])]

    def all(self):
        yield self
        for c in self.children:
            if isinstance(c, Made):
                yield from c.all()


class Maker:
    def __init__(self, seed):
        self.r, self.n = random.Random(seed), 0

    def word(self):
        self.n += 1
        return f"w{self.n}x"

    def inline(self):
        r = self.r
        return [self.word() if r.random() < 0.7 else Made(t := r.choice(["b", "span", "a"]), {"href": f"../p{r.randrange(9)}.{r.choice(['pdf', 'htm'])}"} if t == "a" else {}, [self.word()]) for _ in range(r.randrange(1, 4))]

    def block(self, depth):
        r = self.r
        tag = r.choice(["p", "p", "h1", "h2", "h5", "ul", "table", "div", "section", "blockquote", "script", "img"] if depth < 4 else ["p", "h2"])
        attrs = {"class": r.choice(["news_detail", "time box", "nav-bar", "v_news_content", "x"])} if r.random() < 0.3 else {}
        if tag in ("p", "h1", "h2", "h5", "script"):
            return Made(tag, attrs, ["hidden"] if tag == "script" else self.inline())
        if tag == "img":
            return Made("img", {"src": f"i{r.randrange(99)}.png"})
        if tag == "ul":
            return Made("ul", attrs, [Made("li", {}, [*self.inline(), *([self.block(depth + 1)] if r.random() < 0.2 else [])]) for _ in range(r.randrange(1, 4))])
        if tag == "table":
            return Made("table", attrs, [Made("tr", {}, [Made("td", {"colspan": "2"} if r.random() < 0.2 else {}, self.inline() if r.random() < 0.8 else [self.block(depth + 1)]) for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 4))])
        return Made(tag, attrs, [self.block(depth + 1) if r.random() < 0.7 else self.word() for _ in range(r.randrange(1, 5))])

    def page(self):
        return Made("body", {}, [self.block(0) for _ in range(self.r.randrange(1, 7))])


def size(node):
    return len(" ".join(node.words()))


def plain_main(page):
    """The main element of a page, by walking the generated tree."""
    named = [(lambda n, c=c: c in n.attrs.get("class", "").split()) for c in ("TRS_Editor", "TRS_UEDITOR", "v_news_content")]
    likely = [lambda n, x=x: x in n.attrs.get("class", "") for x in ("content", "article", "detail")] + [lambda n: n.tag == "article"]
    everything = list(page.all())
    for rule, floor in [(f, 0) for f in named] + [(f, 200) for f in likely]:
        first = next((n for n in everything if rule(n) and n.tag != "script"), None)
        if first is not None and size_joined(first) > floor:
            return first
    wide = [n for n in everything if n.tag in ("div", "td", "section")]
    best = max(wide, key=size_joined, default=None)
    return best if best is not None and size_joined(best) else page


def texts(node):
    """Runs of text: words that stand side by side are one."""
    if node.tag == "script":
        return []
    runs, last = [], None
    for c in node.children:
        if isinstance(c, Made):
            runs, last = runs + texts(c), None
        elif last is None:
            runs, last = [*runs, c], c
        else:
            runs[-1] += "  " + c
    return runs


def size_joined(node):
    return len(" ".join(texts(node)))


@pytest.fixture(scope="module")
def made():
    return [Maker(seed).page() for seed in range(150)]


def rows(spark, pages, lax):
    data = [(i, "http://h.example/a/b/c.html", p.html(random.Random(i), lax)) for i, p in enumerate(pages)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def body(found):
    return F.get(F.filter(found, lambda n: n.tag == "body"), 0)


@pytest.mark.parametrize("lax", [False, True])
def test_no_text_is_lost(spark, made, lax):
    d = D.dom(rows(spark, made, lax)).withColumn("found", D.elements("nodes")).withColumn("box", body(F.col("found")))
    got = d.select("page_id", D.markdown_walk("nodes", F.col("box")).alias("walk"), D.markdown_full("nodes", F.col("box"), "url").alias("full"), D.text_of(F.col("nodes")).alias("text")).collect()
    for r in got:
        words = made[r.page_id].words()
        assert r.text.split() == words
        for markdown in (r.walk, r.full):
            assert [w for w in words if w not in markdown] == []
            assert "hidden" not in markdown
        pictures = sum(n.tag == "img" for n in made[r.page_id].all())
        in_tables = sum(n.tag == "img" for t in made[r.page_id].all() if t.tag == "table" for n in t.all())
        assert r.full.count("[image: http://h.example/a/b/i") >= pictures - in_tables


def test_main_container_equals_a_walk_over_the_tree(spark, made):
    d = D.dom(rows(spark, made, False)).withColumn("box", D.main_container(D.elements("nodes")))
    got = {r.page_id: r.text.split() for r in d.select("page_id", D.text_of(D.subtree("nodes", F.col("box"))).alias("text")).collect()}
    assert got == {i: plain_main(p).words() for i, p in enumerate(made)}


def test_visible_blocks_equal_a_walk(spark, made):
    def blocks(node):
        if node.tag in D.NOT_IN_BLOCKS:
            return []
        if node.tag in D.BLOCKS:
            return [(node.tag, " ".join(node.words()))] if node.words() else []
        return [b for c in node.children if isinstance(c, Made) for b in blocks(c)]

    d = D.dom(rows(spark, made, False), drop=D.NOT_IN_BLOCKS)
    got = {r.page_id: [(b.tag, b.text) for b in r.b] for r in d.select("page_id", D.visible_blocks("nodes").alias("b")).collect()}
    assert got == {i: blocks(p) for i, p in enumerate(made)}


def test_nodes_contain_each_other_as_intervals(spark, made):
    t = D.nodes_table(D.dom(rows(spark, made[:20], False)))
    inside = t.alias("x").join(t.alias("y"), (F.col("x.page_id") == F.col("y.page_id")) & (F.col("y.pre") < F.col("x.pre")) & (F.col("x.post") <= F.col("y.post")))
    got = {(r.page_id, r.pre): r.n for r in inside.where("x.tag = '#text' AND y.tag = 'table'").groupBy("x.page_id", "x.pre").agg(F.count("*").alias("n")).collect()}
    want = {(r.page_id, r.pre): r.in_table for r in t.where("tag = '#text' AND in_table > 0").collect()}
    assert got == want and want


def test_missing_end_tags_close_as_in_browsers(spark):
    html = "<p>one<p>two<ul><li>a<li>b</ul><p>three</p><div>four</div><table>five<tr><td>six<td>seven</table>eight"
    d = D.dom(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    got = d.select(D.visible_blocks("nodes").alias("b"), D.markdown_walk("nodes", body_or_root()).alias("m")).first()
    assert [(b.tag, b.text) for b in got.b] == [("p", "one"), ("p", "two"), ("li", "a"), ("li", "b"), ("p", "three"), ("td", "five"), ("td", "six"), ("td", "seven")]
    assert got.m == "one\n\ntwo\n\n- a\n- b\n\nthree\n\nfour\n\n| five | |\n| --- | --- |\n| six | seven |\n\neight"


def body_or_root():
    return F.get(D.elements("nodes"), 0)


def test_null_empty_deep_and_odd_pages(spark):
    odd = ["", None, "just words", "</p></div>", "<div " * 50, "<div>" * 3000 + "deep", "<table><table><table>x", "<a href=x>1<a href=y>2", "&amp", "<!-- no", "<td>loose cell", "<p class>x", "<![CDATA[kept]]>"]
    d = D.dom(spark.createDataFrame(list(enumerate(odd)), "page_id int, html string").withColumn("url", F.lit("http://h.example/")))
    d = d.withColumn("found", D.elements("nodes")).withColumn("box", D.main_container(F.col("found")))
    got = {r.page_id: r for r in d.select("page_id", D.markdown_walk("nodes", F.col("box")).alias("m"), D.title("nodes", F.col("found")).alias("t"), D.anchors("nodes", F.col("found"), "url").alias("a")).collect()}
    assert [got[i].m for i in (0, 1, 2, 3, 5, 8, 10, 12)] == ["", "", "just words", "", "deep", "&", "loose cell", "kept"]
    assert [a.text for a in got[7].a] == ["1", "2"] and "x" in got[6].m and all(r.t == "" for r in got.values())


def test_noise_and_noise_texts_are_left_out(spark):
    html = "<body><div class='top-nav'>menu</div><div id='vsb_content'><p>Back to top</p><p>kept</p><form>no</form></div></body>"
    d = D.dom(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), drop=D.NOISE)
    box = D.main_container(D.elements("nodes"))
    got = d.withColumn("box", box).select("box.selector", D.markdown_walk("nodes", F.col("box"), "^Back to top$").alias("m")).first()
    assert tuple(got) == ("#vsb_content", "kept")


def page(spark, html, url="http://h.example/a/b.html"):
    return D.dom(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))


def test_article_selectors_flags_dates_and_links(spark):
    text = "word " * 40
    cases = [
        (f"<h1>A long title</h1><div class='news_detail'>b</div><div id='vsb_content'>first {text}<a href='x.PDF'>one</a><a href='/a/x.PDF#p'>two</a></div>", "html:#vsb_content", []),
        (f"<title>A long title</title><div class='con'><nav>n</nav>{text}</div><div class='detail'>{text}</div>", "html:.detail", ["fallback_content_selector"]),
        ("<title>A long title</title><div class='content'>short</div>", "html:None", ["no_article_body"]),
        ("<title>A long title</title><div class='TRS_Editor'><img src='p.png'></div>", "html:.TRS_Editor", ["image_evidence_required"]),
    ]
    for html, parser, flags in cases:
        r = D.article(page(spark, html), "page_id", F.lit("hint"), ["pdf"]).first()
        assert (r.title, r.parser) == ("A long title", parser)
        assert set(r.quality_flags) == {*flags, "publication_date_unknown"}
    first = D.article(page(spark, cases[0][0]), "page_id", F.lit("hint"), ["pdf"]).first()
    assert [(a.url, a.filename) for a in first.attachment_links] == [("http://h.example/a/x.PDF", "two")]
    assert D.article(page(spark, "<p>x"), "page_id", F.lit("the hint"), ["pdf"]).first().title == "the hint"


@pytest.mark.parametrize(("html", "want"), [
    ("<meta name='date' content='2024-2-3 10:00'><p>发布时间：2020-01-01</p>", "2024-02-03"),
    ("<meta property='article:published_time' content='soon'><p>发布时间：2020年1月9日</p>", "2020-01-09"),
    ("<p>发布时间：" + "x" * 90 + "2020-01-01</p><span class='info-time'>2021/5/6</span>", "2021-05-06"),
    ("<p>发布日期：2026-02-31</p>", ""), ("<p>2024-01-01</p>", None), ("<div class='date'>" + "x" * 41 + " 2024-01-01</div>", None),
])
def test_publication_dates(spark, html, want):
    assert page(spark, html).select(D.published("nodes", D.elements("nodes")).alias("d")).first().d == want


@pytest.mark.parametrize(("html", "want"), [
    ("<meta property='og:title' content=' From meta '><h1>A heading here</h1>", "From meta"), ("<h1>Short</h1><h2>Long enough</h2>", "Long enough"),
    ("<h1>Contact us now</h1><title>The page title</title>", "The page title"), ("<h1>x</h1>", ""), ("<h1>" + "y" * 400 + "</h1>", "y" * 300),
    ("<h1>First heading <b>bold</b></h1><div class='arti_title'>Named title</div>", "Named title"),
])
def test_titles(spark, html, want):
    assert page(spark, html).select(D.title("nodes", D.elements("nodes"), "Contact|Home").alias("t")).first().t == want


def test_links_of_listings_and_articles(spark):
    html = (
        "<a href='f.pdf'>outside file</a><a href='/rules.htm'>Rules of 2024</a><article><a href='g.DOCX'>inside file</a><a href='h.htm'>Rules inside</a><a href='n.htm'>Rules news</a>"
        "<a href='o.htm'>Rules 2019</a><a href='k.htm'>Rules 2019 standing</a><a href='mailto:x'>Rules mail</a><img src='p.png' alt='plan'><img src='q.png'><img src='icon.png'></article>"
    )
    ask = dict(extensions=["pdf", "docx"], topics=["Rules"], news="news", old="2019", timeless="standing")
    base = "http://h.example/a/"
    got = [tuple(r)[2:] for r in D.discovered(page(spark, html, base + "b.html"), "page_id", F.lit(False), **ask).orderBy("ord").collect()]
    up = base + "b.html"
    assert got == [
        (base + "f.pdf", "outside file", up, "attachment"), (base + "g.DOCX", "inside file", up, "attachment"), (base + "g.DOCX", "inside file", up, "attachment"),
        (base + "h.htm", "Rules inside", None, "page"), (base + "k.htm", "Rules 2019 standing", None, "page"), (base + "p.png", "plan", up, "image"), (base + "q.png", "image", up, "image"),
    ]
    got = [tuple(r)[2:] for r in D.discovered(page(spark, html, base + "b.html"), "page_id", F.lit(True), **ask).orderBy("ord").collect()]
    assert [(u.rpartition("/")[2], p, k) for u, _, p, k in got] == [("f.pdf", None, "attachment"), ("rules.htm", None, "page"), ("g.DOCX", None, "attachment"), ("h.htm", None, "page"), ("k.htm", None, "page")]


def test_resolved_equals_the_standard_join(spark):
    hrefs = ["../g", "./g", "g", "/g/../h", "?y=1", "//o.example/x", "http://z.example/../y", "a/b/../../c", "..", "../..", "../../../x/.", "g?a/../b", "g#s", "x/", " spaced "]
    cases = [(b, h) for b in ("http://h.example/d/e/f.html?q#z", "http://h.example", "https://a.example:8/x/") for h in hrefs]
    got = spark.createDataFrame(cases, "b string, h string").select("b", "h", U.resolved("b", "h").alias("u")).collect()
    assert [(r.b, r.h, r.u) for r in got if r.u != urljoin(r.b, r.h.strip())] == []
    none = spark.createDataFrame([("http://h.example", x) for x in ("", None, "javascript:x()", "mailto:a@b", "#top", "tel:1")], "b string, h string")
    assert {r.u for r in none.select(U.resolved("b", "h").alias("u")).collect()} == {""}


def test_pages_become_arrays_in_small_runs():
    """Of a batch of many pages a task holds the entries of a few, not all."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType

    from tessera.operators import dom as D

    class Pages:
        schema = {k: type("Field", (), {"dataType": t()})() for k, t in (("page_id", LongType), ("url", StringType), ("html", StringType))}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    n = 300
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": ["<p>a</p>" * 50] * n})
    got = list(D.dom(Pages())(iter([batch])))
    assert [x for b in got for x in b.column("page_id").to_pylist()] == list(range(n))
    assert max(len(b.column("nodes").values) for b in got) <= 10_200
