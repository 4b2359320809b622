"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's \s knows it; Java's \s lacks \x1c-\x1f.
SPACE = r"(?U)[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often and in whatever lambda it stands."""
    return F.get(F.transform(F.array(value), use), 0)


_ATOM = re.compile(r"\\[pPxN]\{[^}]*\}|\\.|\(\?[a-zA-Z-]*[:)]|\[\^?\]?(?:\\.|[^\]\\])*\]|[iI]", re.S)


def ignoring_case(pattern: str, flags: str = "") -> str:
    """A pattern that ignores the case of every letter, as SQL engines do, not only that of A-Z
    as Java's (?i) does. With (?u) Java also takes dotless and dotted i for i, which have no case
    in common with it: a class or an i of its own is kept from them. Classes must be plain."""
    def guarded(m: re.Match) -> str:
        atom = m[0]
        if atom.startswith("[^"):
            raise ValueError(f"negated class in {pattern}")
        return "(?-i:[iI])" if atom in "iI" else f"(?:(?-i:(?![ıİ])){atom})" if atom[0] == "[" else atom

    return f"(?iu{flags}){_ATOM.sub(guarded, pattern)}"


def canonical_text(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(col(c), SPACE + "+", " "))


def compact(c: Column | str) -> Column:
    """Without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE + "+", "")


def tidy(c: Column | str, strict: bool = False) -> Column:
    """Full-width and no-break spaces become spaces, runs of blanks one space, three or
    more line ends two. strict also drops zero-width and control characters."""
    x = F.regexp_replace(col(c), "[　 ]", " ")
    if strict:
        x = F.regexp_replace(x, "[​-‏﻿\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    x = F.regexp_replace(x, "[ \t]+", " ")
    return F.btrim(F.regexp_replace(x, "\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def truncated(c: Column | str, limit: int, mark: str = "…") -> Column:
    """The first `limit` characters, followed by the mark if something was cut off."""
    x = col(c)
    return F.when(F.char_length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit(mark))).otherwise(x)


def first_present(*cols: Column | str) -> Column:
    """The first argument that isn't blank, without white space at its ends; else ''."""
    return F.coalesce(*[F.nullif(canonical_ends(c), F.lit("")) for c in cols], F.lit(""))


def canonical_ends(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def token_estimate(c: Column | str) -> Column:
    """Characters divided by three, rounded up."""
    return F.floor((F.char_length(col(c)) + 2) / 3).cast("long")


def distinct_sorted(c: Column, n: int | None = None) -> Column:
    x = F.array_sort(F.array_distinct(c))
    return x if n is None else F.slice(x, 1, n)


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def first_match(rules: list[tuple[str, Column]], default: str | None) -> Column:
    """Name of the first rule that holds."""
    (name, test), *rest = rules
    out = F.when(test, F.lit(name))
    for name, test in rest:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit(default))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _loose(phrase: Column | str) -> Column:
    """A pattern for the characters of a phrase with or without a space between any two."""
    spaced = F.regexp_replace(compact(phrase), "(?s)(.)", r"\\Q$1\\E ?")
    return F.substring(spaced, F.lit(1), F.greatest(F.char_length(spaced) - 2, F.lit(0)))


def _first(body: Column, phrase: Column | str) -> Column:
    """Place `at` (from 1; 0 if it isn't there) and `length` of a phrase in canonical text,
    whatever the white space in either."""
    pattern = _loose(phrase)

    def place(found: Column) -> Column:
        at = F.when((found != "") | (pattern == ""), F.instr(body, found)).otherwise(F.when(found.isNotNull(), 0))
        return F.struct(at.alias("at"), F.char_length(found).alias("length"))

    return let(F.call_function("regexp_extract", body, pattern, F.lit(0)), place)


def evidence_window(text: Column | str, needle: Column | str, margin: int = 100) -> Column:
    """Canonical text around the first place of the needle, wherever either has white
    space; null if it isn't there. An empty needle stands at the beginning."""
    def window(body: Column, f: Column) -> Column:
        start = F.greatest(f["at"] - margin, F.lit(1))
        return F.when(f["at"] > 0, F.substring(body, start, f["at"] - start + f["length"] + margin))

    return let(canonical_text(text), lambda body: let(_first(body, needle), lambda f: window(body, f)))


def quote_span(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Canonical text from the start phrase to the first end phrase that doesn't begin
    before it (but may begin inside it), wherever any of them has white space; null if one
    isn't there."""
    def span(rest: Column, f: Column) -> Column:
        return let(_first(rest, end), lambda g: F.when((f["at"] > 0) & (g["at"] > 0), F.substring(rest, F.lit(1), F.greatest(f["length"], g["at"] - 1 + g["length"]))))

    def from_start(body: Column, f: Column) -> Column:
        return let(F.substring(body, f["at"], F.char_length(body)), lambda rest: span(rest, f))

    return let(canonical_text(text), lambda body: let(_first(body, start), lambda f: from_start(body, f)))


def parse_units(c: Column | str, units: dict[str, int]) -> Column:
    """Number and unit, such as 90s or 20GB, as a count of the smallest unit; null if it
    doesn't parse."""
    x = F.upper(F.btrim(col(c)))
    number = F.regexp_extract(x, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Z]+)$", 1)
    unit = F.regexp_extract(x, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Z]+)$", 2)
    factor = F.create_map(*[F.lit(y) for k, v in units.items() for y in (k.upper(), v)])
    return F.when(number != "", (number.cast("double") * F.try_element_at(factor, unit)).cast("long"))


DURATIONS = {"S": 1, "M": 60, "H": 3600, "D": 86400}
SIZES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def parse_time(c: Column | str, formats: list[str]) -> Column:
    """The first format that parses; null if none does."""
    x = F.btrim(col(c))
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def scoped_id(prefix: str, *parts: Column | str) -> Column:
    """prefix and 24 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *[col(p) for p in parts]), 256), 1, 24))


def polynomial_hash(c: Column | str, base: int = 31, modulus: int = 1 << 32) -> Column:
    """base-31 hash of the code points, modulo 2**32."""
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    code = lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, x: F.pmod(h * base + code(x), F.lit(modulus)))


def after_hint(text: Column | str, hints: list[str], width: int = 60) -> Column:
    """What follows the first of the hints that is there, to the end of its line."""
    x = col(text)
    found = []
    for h in hints:
        rest = F.regexp_extract(x, f"(?s)\\Q{h}\\E(.{{0,{width}}})", 1)
        found.append(F.nullif(F.btrim(F.split_part(rest, F.lit("\n"), F.lit(1)), F.lit(" ：:|")), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def outline(markdown: Column | str, most: int = 30) -> Column:
    """Headings of a Markdown text."""
    lines = F.filter(F.split(col(markdown), "\n"), lambda l: l.rlike(r"^#{1,6}\s+\S"))
    return F.slice(F.transform(lines, lambda l: F.regexp_replace(l, r"^#{1,6}\s+", "")), 1, most)


def snippet_around(text: Column | str, start: Column, end: Column, window: int = 40) -> Column:
    """Text around the characters from start to end (from 0), on one line."""
    x = col(text)
    left = F.greatest(start - window, F.lit(0))
    return F.btrim(F.regexp_replace(F.substring(x, left + 1, F.least(end + window, F.char_length(x)) - left), SPACE + "+", " "))


def matches(text: Column | str, pattern: str, most: int) -> Column:
    """The first `most` matches of a pattern that never matches nothing, as start, end
    (code points from 0, end exclusive) and the match. Places are sums of the lengths of
    the pieces between matches, which a split at the same pattern gives."""
    x = col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.char_length(piece["gap"])
        end = begin + F.char_length(piece["match"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), piece["match"].alias("match")))).alias("out"))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(x, pattern, most + 1), F.lit(1), F.size(found))
        return F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("match")), start, add, lambda s: s["out"])

    return let(F.slice(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), 1, most), placed)


def mentions(text: Column | str, pattern: str, before: int = 45, after: int = 65, most: int = 40) -> Column:
    """The first `most` matches with `before` and `after` code points around each; contexts
    may overlap."""
    def told(x: Column) -> Column:
        context = lambda m: F.substring(x, F.greatest(m["start"] - before, F.lit(0)) + 1, m["end"] + after - F.greatest(m["start"] - before, F.lit(0)))
        return F.transform(matches(x, pattern, most), lambda m: F.struct(m["match"].alias("text"), context(m).alias("context")))

    return let(col(text), told)


def chunks(text: Column | str, joint: str = "\n\n") -> Column:
    """A text cut behind every joint, which each piece but the last keeps; pieces put together
    give the text back. Null gives null, an empty text no piece."""
    parts = F.split(col(text), joint.replace("\n", "\\n"), -1)
    kept = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(joint))).otherwise(x))
    return F.filter(kept, lambda x: x != "")


#: Markdown lines: kind, pattern, part that is the content.
_LINES = (("heading", r"(?s)^(#{1,3})\s+(.+)$", 2), ("bullet", r"(?s)^[-*]\s+(.+)$", 1), ("numbered", r"(?s)^\d+[.)]\s+(.+)$", 1))


def md_blocks(markdown: Column | str) -> Column:
    """Blocks of a Markdown answer as type, level, items: headings of level 1 to 3; runs of
    bullets and of numbered lines, one item a line; other lines as paragraphs, those that
    follow each other joined by a space. Empty lines end a block. Blocks are slices of the
    lines between the places where a kind begins, so each line is looked at once."""
    lines = F.transform(F.split(F.replace(col(markdown), F.lit("\r\n"), F.lit("\n")), "\n", -1), canonical_ends)

    def told(x: Column) -> Column:
        kind = F.when(x == "", "blank")
        value = F.when(x == "", "")
        for name, pattern, part in _LINES:
            kind, value = kind.when(x.rlike(pattern), name), value.when(x.rlike(pattern), F.regexp_extract(x, pattern, part))
        level = F.when(x.rlike(_LINES[0][1]), F.char_length(F.regexp_extract(x, _LINES[0][1], 1)))
        return F.struct(kind.otherwise("paragraph").alias("kind"), level.alias("level"), value.otherwise(x).alias("value"))

    kinds = F.transform(lines, told)

    def cut(k: Column) -> Column:
        begins = lambda i: (F.get(k, i)["kind"] != "blank") & ((i == 0) | (F.get(k, i)["kind"] == "heading") | (F.get(k, i)["kind"] != F.get(k, i - 1)["kind"]))
        return let(F.filter(F.sequence(F.lit(0), F.size(k) - 1), begins), lambda starts: F.transform(starts, lambda at, i: block(k, starts, at, i)))

    def block(k: Column, starts: Column, at: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(k))
        first = F.get(k, at)
        own = F.filter(F.slice(k, at + 1, end - at), lambda x: x["kind"] == first["kind"])
        items = F.transform(own, lambda x: x["value"])
        return F.struct(first["kind"].alias("type"), first["level"].alias("level"), F.when(first["kind"] == "paragraph", F.array(F.array_join(items, " "))).otherwise(items).alias("items"))

    return let(kinds, cut)


def plain_blocks(text: Column | str) -> Column:
    """The lines of a plain text that aren't empty."""
    return F.filter(F.split(col(text), "[\r\n]+"), lambda x: x != "")


def normalized_title(title: Column | str, lead: str, cut: str, site: str) -> Column:
    """A title without what `lead` finds at its beginning (a date), from where `cut` matches
    first (a note on publication), and without what `site` finds (the site's name)."""
    x = F.regexp_replace(canonical_ends(title), f"^(?:{lead})", "")
    return canonical_ends(F.regexp_replace(F.get(F.split(x, cut, 2), 0), site, ""))


def normalized_artifact(text: Column | str, title: Column, attachment: Column) -> Column:
    """A text with plain line ends and at most one empty line; words and numbers stay. The
    heading of one that is no attachment becomes the title."""
    x = F.replace(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    swap = ~F.coalesce(attachment, F.lit(False)) & x.startswith("# ") & (F.coalesce(title, F.lit("")) != "")
    body = F.when(F.instr(x, "\n") > 0, F.substr(x, F.instr(x, "\n") + 1)).otherwise("")
    return canonical_ends(F.regexp_replace(F.when(swap, F.concat(F.lit("# "), title, F.lit("\n"), body)).otherwise(x), "\n{3,}", "\n\n"))


def date_label(day: Column, today: Column, unknown: Column) -> Column:
    """today, yesterday or month-day; `unknown` where that holds, and for null."""
    d = day.cast("date")
    return F.when(unknown | d.isNull(), "unknown").when(d == today, "today").when(d == F.date_sub(today, 1), "yesterday").otherwise(F.concat_ws("-", F.month(d), F.day(d)))


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table under the first: short rows are filled up, bars
    escaped, line ends written as <br>. '' without cells."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.regexp_replace(canonical_ends(c), r"\s*(?:\r\n|\r|\n)\s*", "<br>"), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    filled = F.transform(rows, lambda r: line(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
    rule = F.array(line(F.array_repeat(F.lit("---"), width.cast("int"))))
    return F.when(F.coalesce(width, F.lit(0)) < 1, "").otherwise(F.array_join(F.concat(F.slice(filled, 1, 1), rule, F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0)))), "\n"))


#: Where str.splitlines() ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def first_heading(text: Column | str, subject: str, skipped: list[str], most: int = 8, short: int = 12, least: int = 8, longest: int = 140) -> Column:
    """What stands for the title of a text without one: of its first `most` lines that aren't
    blank (marks of headings left out), the first that has the pattern `subject` and least to
    longest code points. A line that follows one of fewer than `short` code points without a
    digit is read with it. Lines that begin with one of `skipped` don't count. Null if none."""
    lines = F.filter(F.transform(F.split(col(text), LINE_END, -1), canonical_ends), lambda x: x != "")
    first = F.transform(F.slice(lines, 1, most), lambda x: F.regexp_replace(x, rf"^#+{SPACE}*", ""))

    def read(lines: Column, x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        joined = F.when((i > 0) & (F.char_length(before) < short) & ~before.rlike(r"\d"), F.concat(before, x)).otherwise(x)
        return F.when(~any_of([x.startswith(k) for k in skipped]) & F.char_length(joined).between(least, longest) & joined.rlike(subject), joined)

    return let(first, lambda k: F.get(F.array_compact(F.transform(k, lambda x, i: read(k, x, i))), 0))


def evidence_title(raw: Column, generic: str, attachment: Column, heading: Column, original: Column, suffix: str) -> Column:
    """title and source: the heading of the raw page unless it meets `generic`; else, of an
    attachment, its first heading; else the title as it was, without what `suffix` finds."""
    good = F.coalesce((raw != "") & ~raw.rlike(generic), F.lit(False))
    found = F.coalesce(attachment, F.lit(False)) & heading.isNotNull()
    legacy = canonical_ends(F.regexp_replace(F.coalesce(original, F.lit("")), suffix, ""))
    return F.when(good, F.struct(raw.alias("title"), F.lit("raw_html_heading").alias("source"))).when(found, F.struct(heading.alias("title"), F.lit("attachment_first_heading").alias("source"))).otherwise(F.struct(legacy.alias("title"), F.lit("legacy_title").alias("source")))


def media_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".txt"), "text/plain").otherwise("text/html")


def tree_digest(files: DataFrame, tree: str, key: str, content: str, run: int = 4096) -> DataFrame:
    """tree, digest and files: a digest of each tree over runs of keys. Runs of `run` consecutive
    keys are digested from lines key:sha256 in order, then the tree from lines run:digest, so a
    row gathers at most `run` lines, or one line for each run of the tree (a 4096th of its
    files)."""
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2(content, 256))
    part = F.floor(F.col(key) / run)
    joined = lambda k, v: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v.alias("l")))), lambda x: x["l"]), "\n"), 256)
    parts = files.groupBy(tree, part.alias("_part")).agg(joined(key, line).alias("_d"), F.count("*").alias("_n"))
    top = F.concat(F.col("_part").cast("string"), F.lit(":"), F.col("_d"))
    return parts.groupBy(tree).agg(joined("_part", top).alias("digest"), F.sum("_n").alias("files"))
