"""Pages as numbered trees, and what is read from them.

`dom` turns each page into one array of entries in document order: an opening entry for
every element, its texts, and a closing entry. An entry's place in the array is both its
pre- and its post-order number, so a subtree is a slice, and whether one element stands in
another is a comparison of places. Everything else is expressions over that array: no page is
shuffled, and a page is all that is held at once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .html import expand, table_markdown

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SECTIONS = ("p", "div", "section", "article", "blockquote")
#: Elements of which visible_blocks returns the text.
BLOCKS = ("p", "li", "h1", "h2", "h3", "td")
#: Elements without anything to read.
UNSEEN = ("script", "style", "noscript", "template")
#: What is passed over when visible blocks are read.
NOT_IN_BLOCKS = ("script", "style", "nav", "header", "footer", "form", "svg", "noscript", "template")
#: What is left out of articles.
NOT_IN_ARTICLES = ("script", "style", "noscript", "iframe", "form", "input", "button", "template")
#: What counts as noise when a page is normalised.
NOISE = (
    "script", "style", "noscript", "iframe", "svg", "canvas", "template", "form", "input", "select", "textarea", "button",
    "[class*=nav]", "[class*=menu]", "[class*=footer]", "[class*=header]", "[class*=friend]", "[class*=link-list]", "[class*=bread]",
    "[id*=nav]", "[id*=menu]", "[id*=footer]", "[id*=friend]",
    "[class*=slide]", "[class*=banner]", "[class*=carousel]", "[class*=share]", "[class*=qrcode]", "[class*=weixin]", "[class*=comment]", "[class*=stat]", "[class*=counter]",
)
#: Where a page's main text is looked for; those that need only some text, then
#: those that need more than 200 code points of it.
NAMED = (".TRS_Editor", ".TRS_UEDITOR", ".v_news_content", "#vsb_content")
LIKELY = ("[class*=content]", "[class*=article]", "[class*=detail]", "[id*=content]", "[id*=article]", "[id*=detail]", "article", "main")
#: Bodies of articles in the order in which they are tried, then the last resorts.
ARTICLES = (
    "#editor1", "#bfArticleContent", ".TRS_Editor", ".TRS_UEDITOR", "#vsb_content_2", "#vsb_content", ".v_news_content", ".article_content", ".news-content",
    ".article-content", ".newsDetail", ".news_detail", ".detail-content", ".content-detail", ".detail_con", ".guide-section",
)
LAST_RESORT = (".text", ".nr", ".con", ".detail", ".content")
#: Where titles and dates stand, and what a date looks like.
TITLE_METAS = ("ArticleTitle", "article:title", "og:title")
TITLE_NODES = (".article_title", ".arti_title", ".news_title", "h1", "h2", "h3", "title")
DATE_METAS = ("publishdate", "pubdate", "publish_date", "article:published_time", "date")
DATE = r"(20\d{2})\s*[-年/.]\s*(\d{1,2})\s*[-月/.]\s*(\d{1,2})"
DATE_HINTS = ("发布时间", "发布日期", "发表时间", "发布：")
DATE_NODES = ("[class*=time]", "[class*=date]", "[id*=time]", "[id*=date]")

#: Most elements inside each other, as in browsers; deeper ones become siblings.
DEEPEST = 512
#: Entries of whole pages that a task makes into arrays at once.
HELD = 10_000
_ENDS_P = {*SECTIONS, *HEADINGS, "address", "aside", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "pre", "table", "ul"}
_CELLS = {"td", "th", "caption"}
_GROUPS = {"thead", "tbody", "tfoot"}
_TABLE_PARTS = {*_CELLS, *_GROUPS, "tr", "col", "colgroup", "table"}
#: What a starting element ends, and how far up it looks.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"table"} | _CELLS),
    **dict.fromkeys(_CELLS, (_CELLS, {"tr", "table"})), "tr": ({"tr"} | _CELLS, {"table"}), **dict.fromkeys(_GROUPS, ({"tr"} | _CELLS | _GROUPS, {"table"})),
    **dict.fromkeys(_ENDS_P, ({"p"}, {"table", "button"} | _CELLS)),
}
_COUNTED = {"a": "a", "table": "table", "li": "li", **dict.fromkeys(HEADINGS, "h")}
_FIELDS = ("tag", "close", "in_a", "in_table", "in_li", "in_h", "in_block", "attrs", "text", "chars", "texts")
_NODE = "array<struct<tag:string,close:int,in_a:int,in_table:int,in_li:int,in_h:int,in_block:int,attrs:map<string,string>,text:string,chars:int,texts:int>>"


def _selector(selector: str) -> tuple[str, str]:
    m = re.fullmatch(r"([.#]?)([\w-]+)|\[(class|id)\*=([\w-]+)\]", selector)
    if not m:
        raise ValueError(f"not a selector: {selector}")
    return (m[3] + "*", m[4]) if m[3] else (m[1] or "tag", m[2])


class _Tree(HTMLParser):
    """Entries of one page. Elements that match `drop` leave nothing; end tags that are
    missing or have no start are put right as browsers do, so that no text is lost; text in a
    table outside its cells gets a cell."""

    def __init__(self, drop: Iterable[str] = ()) -> None:
        super().__init__(convert_charrefs=True)
        rules = [_selector(s) for s in drop]
        self.dropped = {v for k, v in rules if k == "tag"}
        self.dropped_if = [r for r in rules if r[0] != "tag"]
        self.nodes: list[list] = []
        self.stack: list[tuple] = []  # tag, place (-1: hidden), counts, chars and texts before
        self.chars = self.texts = 0
        self._open("#root", [])

    def _hidden(self, tag: str, attrs: dict) -> bool:
        if tag in self.dropped:
            return True
        names = {"class": attrs.get("class", ""), "id": attrs.get("id", "")}
        holds = {".": lambda v: v in names["class"].split(), "#": lambda v: v == names["id"], "class*": lambda v: v in names["class"], "id*": lambda v: v in names["id"]}
        return any(holds[k](v) for k, v in self.dropped_if)

    def _open(self, tag: str, attrs: list) -> None:
        if len(self.stack) >= DEEPEST:
            self._close()
        up = self.stack[-1] if self.stack else ("", 0, (0, 0, 0, 0, 0), 0, 0)
        place, known = -1, {k: v or "" for k, v in reversed(attrs)}
        counts = up[2]
        if up[1] >= 0 and not self._hidden(tag, known):
            place = len(self.nodes)
            self.nodes.append([tag, place, *counts, list(known.items()), None, 0, 0])
            kind = _COUNTED.get(tag)
            counts = tuple(n + (kind == k) for n, k in zip(counts[:4], ("a", "table", "li", "h"), strict=True)) + (counts[4] + (tag in BLOCKS),)
        self.stack.append((tag, place, counts, self.chars, self.texts))

    def _close(self) -> None:
        tag, place, _, chars, texts = self.stack.pop()
        if place < 0:
            return
        node = self.nodes[place]
        node[1], node[9], node[10] = len(self.nodes), self.chars - chars, self.texts - texts
        self.nodes.append([f"/{tag}", place, *node[2:7], None, None, 0, 0])
        if tag == "table":
            node[8] = table_markdown(expand(self._rows(place)))

    def _rows(self, table: int) -> list[list[tuple[str, int, int]]]:
        rows, owner = [], {}
        i, end = table + 1, len(self.nodes) - 1
        while i < end:
            tag, close, *_, attrs = self.nodes[i][:8]
            if tag in ("tr", "caption"):
                owner[i] = len(rows)
                rows.append([])
            if tag in _CELLS:
                up = max((r for r in owner if r <= i and self.nodes[r][1] >= close), default=None)
                words = " ".join(x for x in (n[8].strip() for n in self.nodes[i:close] if n[0] == "#text") if x)
                span = lambda k, most, a=dict(attrs): min(most, max(1, int(a[k]))) if a.get(k, "").isascii() and a.get(k, "").isdigit() else 1
                if up is not None:
                    rows[owner[up]].append((" ".join(words.split()), span("rowspan", 200), span("colspan", 60)))
            for r in [r for r in owner if self.nodes[r][1] < i]:
                del owner[r]
            i += 1
        return [r for r in rows if r]

    def _end(self, tags: set[str], limits: set[str]) -> None:
        at = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                at = i
            elif self.stack[i][0] in limits:
                break
        while at is not None and len(self.stack) > at:
            self._close()

    def _in_cell(self, tag: str) -> None:
        """Rows and cells that the page leaves out before `tag` (or text) in a table."""
        top = self.stack[-1][0]
        if top not in ("table", "tr") and top not in _GROUPS:
            return
        if tag in ("td", "th") or tag not in _TABLE_PARTS:
            if top != "tr":
                self._open("tr", [])
            if tag not in ("td", "th"):
                self._open("td", [])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        self._in_cell(tag)
        self._open(tag, attrs)
        if tag in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        limits = set() if tag in ("table", "body", "html") else {"table"} if tag in _TABLE_PARTS else {"table"} | _CELLS
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._close()
                return
            if self.stack[i][0] in limits:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._in_cell("")
        if self.stack[-1][1] < 0:
            return
        words = data.strip()
        last = self.nodes[-1]
        if last[0] == "#text":
            before = last[8].strip()
            last[8] += data
            words = last[8].strip()
            self.chars, self.texts = self.chars - len(before), self.texts - bool(before)
        else:
            self.nodes.append(["#text", len(self.nodes), *self.stack[-1][2], None, data, 0, 0])
        self.chars, self.texts = self.chars + len(words), self.texts + bool(words)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def tree(html: str, drop: Iterable[str] = ()) -> list[list]:
    page = _Tree(drop)
    page.feed(html)
    page.close()
    while page.stack:
        page._close()
    return page.nodes


def plain_text(html: str) -> str:
    """The texts of a page that are shown, its tables as Markdown, between empty lines."""
    rows = [n[8].strip() for n in tree(html, UNSEEN) if n[3] == 0 and n[0] in ("#text", "table")]
    return "\n\n".join(x for x in rows if x)


def dom(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", drop: Sequence[str] = UNSEEN) -> DataFrame:
    """key, url and nodes of each page; elements that match a selector of `drop` are left out
    with all that is in them. Selectors are a tag, .class, #id, [class*=x] or [id*=x]. Entries
    have tag (`#text` for texts, `/p` for the end of a p; the first is `#root`), close (the
    place of the other end), in_a, in_table, in_li, in_h and in_block (how many such elements
    it stands in), attrs, text (of tables: Markdown), and the code points and number of the
    texts in an element. A null page is empty."""
    for s in drop:
        _selector(s)
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    types = (pa.string(), *[pa.int32()] * 6, pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lo, sources = 0, batch.column(2)
            while lo < len(sources):
                hi, held, ends = lo, [], [0]
                while hi < len(sources) and len(held) < HELD:
                    held += tree(sources[hi].as_py() or "", drop)
                    ends.append(len(held))
                    hi += 1
                columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), types, strict=True)]
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=list(_FIELDS)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), nodes], names=[key, url, "nodes"])
                lo = hi

    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, nodes {_NODE}")


def nodes_table(pages: DataFrame, key: str = "page_id", nodes: str = "nodes") -> DataFrame:
    """One row per element or text: key, pre, post and the fields of an entry; element x
    stands in element y of the same page if y.pre < x.pre and x.post <= y.post."""
    rows = pages.select(key, F.posexplode(nodes).alias("pre", "n")).where(~F.col("n.tag").startswith("/"))
    return rows.select(key, "pre", F.col("n.close").alias("post"), *[f"n.{c}" for c in _FIELDS if c != "close"])


def elements(nodes: Column | str) -> Column:
    """The opening entries, each with its place as `open`."""
    placed = F.transform(nodes, lambda n, i: F.struct(i.alias("open"), *[n[c].alias(c) for c in _FIELDS]))
    return F.filter(placed, lambda n: ~n.tag.startswith("/") & (n.tag != "#text"))


def attribute(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node.attrs, F.lit(name)), F.lit(""))


def matches(node: Column, selector: str) -> Column:
    kind, value = _selector(selector)
    if kind == "tag":
        return node.tag == value
    if kind == ".":
        return F.array_contains(F.split(attribute(node, "class"), r"\s+"), value)
    if kind == "#":
        return attribute(node, "id") == value
    return F.contains(attribute(node, kind[:-1]), F.lit(value))


def _first(found: Column, selectors: Sequence[str]) -> Column:
    return F.get(F.filter(found, lambda n: X.any_of([matches(n, s) for s in selectors])), 0)


def length(node: Column) -> Column:
    """Code points of an element's texts, joined by single spaces."""
    return node.chars + F.greatest(node.texts - 1, F.lit(0))


def subtree(nodes: Column | str, node: Column) -> Column:
    return F.slice(nodes, node.open + 1, node.close - node.open + 1)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{X.SPACE}+|{X.SPACE}+$", "")


def text_of(nodes: Column, joint: str = " ") -> Column:
    """The texts of a slice without the white space around each, joined."""
    return F.array_join(F.filter(F.transform(F.filter(nodes, lambda n: n.tag == "#text"), lambda n: _stripped(n.text)), lambda s: s != ""), joint)


def cleaned(c: Column) -> Column:
    """Wide and fixed spaces as plain ones, runs of blanks as one, at most one empty line."""
    c = F.regexp_replace(F.translate(c, "　\xa0", "  "), "[ \t]+", " ")
    return _stripped(F.regexp_replace(c, "\n{3,}", "\n\n"))


def lines_tidied(c: Column) -> Column:
    """cleaned, without white space at the ends of lines and without signs that don't show."""
    c = F.regexp_replace(F.translate(c, "　\xa0\r", "  \n"), "[ \t]+", " ")
    return X.tidy(F.regexp_replace(c, " ?\n ?", "\n"), strict=True)


#: What is told of a container.
_BOX = ("open", "close", "in_a", "in_table", "in_li", "in_h")


def main_container(found: Column, named: Sequence[str] = NAMED, likely: Sequence[str] = LIKELY, least: int = 200) -> Column:
    """The element that holds the main text, as selector, open, close: of each selector in
    turn the first element, if it has text (for likely ones, more than `least` code points);
    else the first of the longest div, td or section; else the body, or the whole page."""
    box = lambda n, how: F.struct(F.lit(how).alias("selector"), *[n[c].alias(c) for c in _BOX])
    tries = []
    for s, floor in [(s, 0) for s in named] + [(s, least) for s in likely]:
        tries.append(X.let(_first(found, [s]), lambda n: F.when(length(n) > floor, box(n, s))))  # noqa: B023
    wide = F.filter(found, lambda n: n.tag.isin("div", "td", "section") & (n.chars > 0))
    best = lambda w: X.let(F.array_max(F.transform(w, lambda n: F.struct(length(n).alias("size"), (-n.open).alias("less")))), lambda m: F.get(F.filter(w, lambda x: x.open == -m.less), 0))
    tries.append(X.let(wide, lambda w: X.let(best(w), lambda n: F.when(n.isNotNull(), box(n, "longest")))))
    return F.coalesce(*tries, X.let(F.coalesce(_first(found, ["body"]), F.get(found, 0)), lambda n: box(n, "body")))


def article_container(found: Column, selectors: Sequence[str] = ARTICLES, last: Sequence[str] = LAST_RESORT) -> Column:
    """The body of an article, as main_container gives it, and whether it was found by a last
    resort; null if there is none. Each selector's first element is taken if it has text or
    an image; then, of the last resorts, the first element with more than 150 code points,
    without a nav and with fewer than 12 links."""
    box = lambda n, how, late: F.struct(F.lit(how).alias("selector"), *[n[c].alias(c) for c in _BOX], F.lit(late).alias("fallback"))
    inside = lambda n, tag: F.filter(found, lambda x: (x.tag == tag) & (x.open > n.open) & (x.close < n.close))
    tries = []
    for s in selectors:
        tries.append(X.let(_first(found, [s]), lambda n: F.when((n.chars > 0) | (F.size(inside(n, "img")) > 0), box(n, s, False))))  # noqa: B023
    for s in last:
        long = F.filter(found, lambda n: matches(n, s) & (n.chars > 150))  # noqa: B023
        n = F.get(F.filter(long, lambda n: (F.size(inside(n, "nav")) == 0) & (F.size(inside(n, "a")) < 12)), 0)
        tries.append(X.let(n, lambda n: F.when(n.isNotNull(), box(n, s, True))))  # noqa: B023
    return F.coalesce(*tries)


def _marks(tag: Column, levels: int = 6) -> Column:
    return F.repeat(F.lit("#"), F.least(F.substring(tag, 2, 1).cast("int") + 1, F.lit(levels)))


def markdown_walk(nodes: Column | str, box: Column, noise: str | None = None) -> Column:
    """The subtree of `box` as Markdown: every text on a line of its own; blocks, headings
    (one level down), lists and tables between empty lines; a list item and a heading is one
    line of all its text. Texts that match the pattern `noise` are left out."""
    part = subtree(nodes, box)

    def kept(c: Column) -> Column:
        return F.when(c == "", None).otherwise(c) if noise is None else F.when((c != "") & ~c.rlike(noise), c)

    def piece(n: Column) -> Column:
        tag = F.regexp_replace(n.tag, "^/", "")
        closing = n.tag.startswith("/")
        deep = (n.in_table > box.in_table) | (n.in_li > box.in_li) | (n.in_h > box.in_h)
        flat = lambda: kept(cleaned(F.regexp_replace(text_of(F.slice(nodes, n_open(n) + 1, n.close - n_open(n) + 1)), f"{X.SPACE}+", " ")))
        return (
            F.when(deep, "")
            .when(n.tag == "#text", F.coalesce(F.concat(kept(cleaned(n.text)), F.lit("\n")), F.lit("")))
            .when(tag.isin(*SECTIONS, "ul", "ol") | (n.tag == "br"), "\n")
            .when(closing, "")
            .when(n.tag == "table", F.concat(F.lit("\n"), n.text, F.lit("\n\n")))
            .when(n.tag.isin(*HEADINGS), F.coalesce(F.concat(F.lit("\n"), _marks(n.tag), F.lit(" "), flat(), F.lit("\n\n")), F.lit("")))
            .when(n.tag == "li", F.coalesce(F.concat(F.lit("- "), flat(), F.lit("\n")), F.lit("")))
            .otherwise("")
        )

    n_open = lambda n: n.open
    placed = F.transform(part, lambda n, i: F.struct((i + box.open).alias("open"), *[n[c].alias(c) for c in _FIELDS]))
    return cleaned(F.array_join(F.transform(placed, piece), ""))


def markdown_full(nodes: Column | str, box: Column, base: Column | str, image: str = "image") -> Column:
    """The subtree of `box` as Markdown with its links and images, their addresses resolved
    against `base`: blocks between empty lines, headings one level down, list items on lines
    of their own, tables with their spans written out."""
    base = X.col(base)
    part = subtree(nodes, box)

    def inline(n: Column) -> Column:
        picture = F.concat(F.lit(f"\n\n[{image}: "), U.resolved(base, attribute(n, "src")), F.lit("]\n\n"))
        return F.when(n.tag == "#text", n.text).when(n.tag == "img", picture).when(n.tag == "br", "\n").otherwise("")

    def piece(n: Column) -> Column:
        tag = F.regexp_replace(n.tag, "^/", "")
        inner = F.array_join(F.transform(F.slice(nodes, n.open + 1, n.close - n.open + 1), inline), "")

        def link(x: Column) -> Column:
            full = x["address"].rlike("^https?:") & (attribute(n, "href") != "") & (x["words"] != "")
            return F.when(full, F.concat(F.lit("["), x["words"], F.lit("]("), x["address"], F.lit(")"))).otherwise(x["inner"])

        linked = X.let(inner, lambda i: X.let(F.struct(i.alias("inner"), lines_tidied(i).alias("words"), U.resolved(base, attribute(n, "href")).alias("address")), link))
        return (
            F.when((n.in_table > box.in_table) | (n.in_a > box.in_a), "")
            .when(n.tag == "table", F.concat(F.lit("\n\n"), n.text, F.lit("\n\n")))
            .when(n.tag == "a", linked)
            .when(n.tag.isin(*HEADINGS), F.concat(F.lit("\n\n"), _marks(n.tag), F.lit(" ")))
            .when(n.tag == "li", "\n- ")
            .when(n.tag == "/li", "\n")
            .when(tag.isin(*SECTIONS, *HEADINGS, "ul", "ol"), "\n\n")
            .otherwise(inline(n))
        )

    placed = F.transform(part, lambda n, i: F.struct((i + box.open).alias("open"), *[n[c].alias(c) for c in _FIELDS]))
    return lines_tidied(F.array_join(F.transform(placed, piece), ""))


def visible_blocks(nodes: Column | str) -> Column:
    """tag and text of the outermost p, li, h1 to h3 and td with text, in document order."""
    found = F.filter(elements(nodes), lambda n: n.tag.isin(*BLOCKS) & (n.in_block == 0))
    blocks = F.transform(found, lambda n: F.struct(n.tag.alias("tag"), F.regexp_replace(text_of(subtree(nodes, n)), f"{X.SPACE}+", " ").alias("text")))
    return F.filter(blocks, lambda b: b.text != "")


def _meta(found: Column, names: Sequence[str]) -> Column:
    """Contents of meta elements by the order of names, then of the page."""
    metas = F.filter(found, lambda n: (n.tag == "meta") & (attribute(n, "content") != ""))
    named = lambda name: F.filter(metas, lambda n: (attribute(n, "name") == name) | (attribute(n, "property") == name))
    return F.flatten(F.array(*[F.transform(named(x), lambda n: attribute(n, "content")) for x in names]))


def title(nodes: Column | str, found: Column, generic: str | None = None, metas: Sequence[str] = TITLE_METAS, selectors: Sequence[str] = TITLE_NODES, least: int = 6, most: int = 300) -> Column:
    """A page's title: the first of the meta elements, else of each selector's first element
    in turn the text, if it has `least` code points and doesn't begin with the pattern
    `generic`; else ''. At most `most` code points."""
    tries = [F.get(F.transform(_meta(found, metas), cleaned), 0)]
    fits = lambda w: (F.char_length(w) >= least) & ~w.rlike(f"^(?:{generic})") if generic else F.char_length(w) >= least
    for s in selectors:
        words = X.let(_first(found, [s]), lambda n: cleaned(text_of(subtree(nodes, n))))
        tries.append(X.let(words, lambda w: F.when(fits(w), w)))
    return F.substring(F.coalesce(*tries, F.lit("")), 1, most)


def day(text: Column, pattern: str = DATE) -> Column:
    """The first date of a text as yyyy-MM-dd; '' if it isn't in the calendar, null without
    one."""
    def told(p: Column) -> Column:
        found = F.concat_ws("-", p["y"], F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0")).try_cast("date")
        return F.when(p["y"] != "", F.coalesce(F.date_format(found, "yyyy-MM-dd"), F.lit("")))

    return X.let(text, lambda t: X.let(F.struct(*[F.regexp_extract(t, pattern, i).alias(c) for i, c in ((1, "y"), (2, "m"), (3, "d"))]), told))


def after_hint(text: Column, hints: Sequence[str] = DATE_HINTS, pattern: str = DATE, width: int = 80) -> Column:
    """The date in the `width` code points from the first place of each hint in turn."""
    return F.coalesce(*[F.when(F.locate(h, text) > 0, day(F.substring(text, F.locate(h, text), F.lit(width)), pattern)) for h in hints])


def published(nodes: Column | str, found: Column, hints: Sequence[str] = DATE_HINTS, pattern: str = DATE, width: int = 80) -> Column:
    """When a page was published: by its meta elements, else in the `width` code points from
    the first place of each hint in turn, else in the first small element (40 code points)
    whose class or id tells of a time or date. Null without any; '' for a day that isn't in the calendar."""
    whole = text_of(X.col(nodes), "\n")
    metas = F.filter(F.transform(_meta(found, DATE_METAS), lambda c: day(c, pattern)), lambda d: d.isNotNull())
    near = X.let(whole, lambda w: after_hint(w, hints, pattern, width))
    small = F.filter(found, lambda n: X.any_of([matches(n, s) for s in DATE_NODES]) & (n.chars > 0) & (length(n) <= 40))
    days = F.filter(F.transform(small, lambda n: day(cleaned(text_of(subtree(nodes, n))), pattern)), lambda d: d.isNotNull())
    return F.coalesce(F.get(metas, 0), near, F.get(days, 0))


def anchors(nodes: Column | str, found: Column, base: Column | str) -> Column:
    """url (resolved), text, open, close of every link; those that lead to no page are left
    out."""
    rows = F.transform(F.filter(found, lambda n: (n.tag == "a") & F.map_contains_key(n.attrs, "href")), lambda n: F.struct(
        U.resolved(X.col(base), attribute(n, "href")).alias("url"), F.regexp_replace(text_of(subtree(nodes, n)), f"{X.SPACE}+", " ").alias("text"), n.open.alias("open"), n.close.alias("close"),
    ))
    return F.filter(rows, lambda a: a.url != "")


def article(pages: DataFrame, key: str, hint: Column | str, extensions: Sequence[str], generic: str | None = None, image: str = "image", hints: Sequence[str] = DATE_HINTS, title_rule=lambda c: c, pattern: str = DATE, selectors: Sequence[str] = ARTICLES) -> DataFrame:  # noqa: ANN001
    """key, title, clean_content, published_at, quality_flags, attachment_links (url,
    filename) and parser of pages (key, url, nodes, parsed with drop=NOT_IN_ARTICLES): the article that a page holds. The hint
    stands for a title that the page lacks. Without a body the content is empty: the whole
    page is never taken for one."""
    p = pages.withColumn("_found", elements("nodes"))
    p = p.withColumn("_box", article_container(F.col("_found"), selectors)).withColumn("_title", title_rule(title("nodes", F.col("_found"), generic)))
    box = F.col("_box")
    links = F.filter(anchors("nodes", F.col("_found"), "url"), lambda a: F.lower(U.extension(a.url)).isin(*extensions))
    links = F.transform(links, lambda a: F.struct(U.canonical(a.url).alias("url"), a.text.alias("filename")))
    p = p.select(
        key, F.when(F.col("_title") == "", title_rule(X.col(hint))).otherwise(F.col("_title")).alias("title"), "_box",
        F.when(box.isNotNull(), markdown_full("nodes", box, "url", image)).otherwise("").alias("clean_content"),
        F.nullif(published("nodes", F.col("_found"), hints, pattern), F.lit("")).alias("published_at"), links.alias("_links"),
    )
    flags = X.reasons(("fallback_content_selector", box.fallback), ("publication_date_unknown", F.col("published_at").isNull()), ("no_article_body", box.isNull()), ("image_evidence_required", F.contains("clean_content", F.lit(f"[{image}: "))))
    # of links that repeat, the place of the first and the name of the last
    urls = F.array_distinct(F.transform("_links", lambda a: a.url))
    once = F.transform(urls, lambda u: F.element_at(F.filter("_links", lambda a: a.url == u), -1))
    return p.select(key, "title", "clean_content", "published_at", flags.alias("quality_flags"), once.alias("attachment_links"), F.concat(F.lit("html:"), F.coalesce(box.selector, F.lit("None"))).alias("parser"))


def discovered(pages: DataFrame, key: str, listing: Column, extensions: Sequence[str], topics: Sequence[str], news: str, old: str | None = None, timeless: str = "(?!)", main: Sequence[str] = ("article",), icons: str = "(?i)icon|qrcode|share|weixin|logo", alt: str = "image") -> DataFrame:
    """key, ord, url, title, parent, kind: what pages (key, url, nodes) lead to, in order of
    discovery. Of a listing: its links to files (attachment) and those whose text is of one
    of the topics (page). Of an article: all files, then the links within its main element
    (of the whole page if it has none), then the images of the main element but for icons;
    files and images have the page as parent. Links whose text matches `news`, or `old` (a
    year gone by) but not `timeless`, are no pages. Feed it to a frontier merge, where the first
    title wins."""
    p = pages.withColumn("_found", elements("nodes")).withColumn("_listing", F.coalesce(listing, F.lit(False)))
    p = p.withColumn("_main", _first(F.col("_found"), main)).withColumn("_links", anchors("nodes", F.col("_found"), "url"))
    of_kind = lambda a, kind, parent: F.struct(a.url.alias("url"), a.text.alias("title"), parent.alias("parent"), F.lit(kind).alias("kind"))
    is_file = lambda a: F.lower(U.extension(a.url)).isin(*extensions)
    up = F.when(~F.col("_listing"), F.col("url"))
    files = F.transform(F.filter("_links", is_file), lambda a: of_kind(a, "attachment", up))
    inside = F.filter("_links", lambda a: F.col("_listing") | F.col("_main").isNull() | ((a.open > F.col("_main.open")) & (a.close < F.col("_main.close"))))
    wanted = lambda a: X.any_of([a.text.rlike(t) for t in topics]) & ~a.text.rlike(news) & (~a.text.rlike(old) | a.text.rlike(timeless) if old else F.lit(True))
    rows = F.transform(F.filter(inside, lambda a: is_file(a) | wanted(a)), lambda a: F.when(is_file(a), of_kind(a, "attachment", up)).otherwise(of_kind(a, "page", F.lit(None).cast("string"))))
    shown = F.filter("_found", lambda n: (n.tag == "img") & (n.open > F.col("_main.open")) & (n.close < F.col("_main.close")) & (attribute(n, "src") != ""))
    images = F.transform(shown, lambda n: F.struct(U.resolved(F.col("url"), attribute(n, "src")).alias("url"), F.coalesce(F.nullif(attribute(n, "alt"), F.lit("")), F.lit(alt)).alias("title"), F.col("url").alias("parent"), F.lit("image").alias("kind")))
    images = F.filter(F.coalesce(images, F.array()), lambda i: ~i.url.rlike(icons) & (i.url != ""))
    found = F.when(F.col("_listing"), rows).otherwise(F.concat(files, rows, images))
    return p.select(key, F.posexplode(found).alias("ord", "_l")).select(key, "ord", "_l.url", "_l.title", "_l.parent", "_l.kind")
