"""Markdown blocks, chunks, kinds, sources and ledger admission on inline cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import admission as A
from tessera.operators import rules as R


def plain_blocks(markdown):
    """Blocks by a walk over the lines, keeping what is open."""
    out, paragraph, items = [], [], None

    def flush():
        nonlocal paragraph, items
        if paragraph:
            out.append(("paragraph", None, [" ".join(paragraph)]))
        if items:
            out.append(items)
        paragraph, items = [], None

    for line in markdown.replace("\r\n", "\n").split("\n"):
        s = line.strip()
        heading, bullet, number = re.match(r"(#{1,3})\s+(.+)$", s, re.DOTALL), re.match(r"[-*]\s+(.+)$", s, re.DOTALL), re.match(r"\d+[.)]\s+(.+)$", s, re.DOTALL)
        if not s:
            flush()
        elif heading:
            flush()
            out.append(("heading", len(heading[1]), [heading[2]]))
        elif bullet or number:
            kind = "bullet" if bullet else "numbered"
            if paragraph or (items and items[0] != kind):
                flush()
            items = items or (kind, None, [])
            items[2].append((bullet or number)[1])
        else:
            if items:
                flush()
            paragraph.append(s)
    flush()
    return out


def test_blocks_equal_a_walk(spark):
    r = random.Random(2)
    lines = ["# One", "## two  words", "#### four", "#none", "- a", "* b", "-c", "1. x", "22) y", "3.z", "plain", "  indented  ", "", " ", "\t- tab", "line\r", "é — ü"]
    texts = ["", "\n", "x", "- a\n- b\n\n- c\n1. d\ntext\nmore\n# h\n# i\n* e"] + ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 25))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: [(b.type, b.level, list(b["items"])) for b in x.b] for x in df.select("i", X.md_blocks("t").alias("b")).collect()}
    assert got == {i: plain_blocks(t) for i, t in enumerate(texts)}
    assert spark.range(1).select(X.md_blocks(F.lit(None).cast("string")).alias("b")).first().b is None


@pytest.mark.parametrize("text", ["", "one", "a\n\nb", "a\n\n", "\n\n\n\n", "\n\na\nb\n\n\nc", "\n"])
def test_chunks_give_the_text_back(spark, text):
    got = spark.range(1).select(X.chunks(F.lit(text)).alias("c")).first().c
    parts = text.split("\n\n")
    want = [p for p in [x + "\n\n" for x in parts[:-1]] + [parts[-1]] if p]
    assert got == want and "".join(got) == text


def test_kinds_override_in_order(spark):
    patterns = {"regulation": "rule", "guide": "guide", "calendar": "calendar", "form": "form", "result": "list"}
    cases = {("rule guide", False): "regulation", ("guide", True): "guide", ("", True): "attachment", ("", False): "notice", (None, True): "attachment", ("rule calendar", True): "calendar", ("guide form", False): "form", ("form list", True): "result"}
    df = spark.createDataFrame([(t, a) for t, a in cases], "t string, a boolean")
    assert {(r.t, r.a): r.k for r in df.select("t", "a", R.document_type(F.col("t"), patterns, F.col("a")).alias("k")).collect()} == cases


def test_sources_by_host_desk_and_bracket(spark):
    names = spark.createDataFrame([("econ", "Economics", "college"), ("jwc", "Studies", "department"), ("www", "School", "department")], "label string, name string, kind string")
    pages = [("http://econ.a.example/x", None), ("http://JWC.a.example/x", ""), ("http://www.a.example/", ""), ("http://i.a.example/lib/1", "[Sports] x"), ("http://i.a.example/z", "[Sports] x"), ("http://i.a.example/z", "x"), ("http://who.a.example/", "")]
    got = R.source_metadata(spark.createDataFrame(pages, "url string, title string"), "url", "title", names, "i", "Portal", [("/lib/", "Library")], ["Library"], ["www"], r"^\[([^\]]+)\]")
    rows = {(r.url, r.title): tuple(r)[2:] for r in got.collect()}
    assert list(rows[p] for p in pages) == [
        ("Economics", "Economics", "Economics", "college", "OFFICIAL_COLLEGE"), ("Studies", "Studies", None, "school", "OFFICIAL_DEPARTMENT"), ("School", "School", None, "school", "OFFICIAL_SCHOOL"),
        ("Portal", "Library", None, "school", "OFFICIAL_DEPARTMENT"), ("Portal", "Sports", None, None, "OFFICIAL_DEPARTMENT"), ("Portal", None, None, None, "OFFICIAL_DEPARTMENT"), (None, None, None, None, "OFFICIAL_DEPARTMENT"),
    ]


def test_ledger_reasons_one_by_one(spark):
    long = "The rules say that fees are due in May. " * 6
    sources = [(i, f"https://h.example/s{i}/", "static") for i in range(1, 13)]
    sources[1] = (2, sources[1][1], None)
    found = [(100 + i, f"http://H.example/s{i}", long, f"hash{i}", ["harmless"], False) for i in range(1, 13) if i != 3]
    change = {4: (4, ["shouting", "harmless"]), 5: (5, True), 6: (2, "too short"), 7: (0, 7), 8: (3, "known")}
    found = [tuple(change[i - 100][1] if i - 100 in change and k == change[i - 100][0] else v for k, v in enumerate(row)) for row in found for i in [row[0]]]
    ledger = [(i, "fees", ["fees are  due"], ["when"]) for i in range(1, 13) if i != 9]
    ledger[9 - 1 - 0] = (10, "weather", ["fees are due"], ["when"])
    ledger[9] = (11, "fees", ["fees are due", "nothing of the kind stands here at all"], ["when"])
    ledger[10] = (12, "fees", ["Fees"], ["when", "who", "how"])
    s = spark.createDataFrame(sources, "source_id long, url string, source_route string")
    c = spark.createDataFrame(found, "candidate_id long, url string, content string, content_hash string, quality_flags array<string>, contains_pii boolean")
    led = spark.createDataFrame(ledger, "source_id long, topic string, excerpts array<string>, intents array<string>")
    q = spark.createDataFrame([(i, "when") for i in range(1, 13)], "source_id long, intent string")
    inv = spark.createDataFrame([(7, None, None), (None, None, "known"), (None, "", "")], "candidate_id long, url string, content_hash string")
    got = {r.source_id: list(r.reasons) for r in A.ledger_admission(s, c, led, q, inv, ["fees"], "static", ["shouting"]).collect()}
    assert got == {
        1: [], 2: ["route_not_static_document"], 3: ["source_body_not_parsed"], 4: ["quality:shouting"], 5: ["pii_detected"], 6: ["content_too_short", "evidence_excerpt_missing:fees are  due"], 7: ["already_in_current_knowledge_base"],
        8: ["duplicate_current_clean_content"], 9: ["no_completed_evidence_review"], 10: ["topic_not_in_taxonomy"], 11: ["evidence_excerpt_missing:nothing of the kind stan"], 12: ["evidence_excerpt_missing:Fees", "intent_not_declared_for_source:how,who"],
    }


def plain_heading(text, subject, skipped):
    lines = [re.sub(r"^#+\s*", "", x.strip()) for x in text.splitlines() if x.strip()]
    for i, line in enumerate(lines[:8]):
        if line.startswith(tuple(skipped)):
            continue
        joined = lines[i - 1] + line if i and len(lines[i - 1]) < 12 and not re.search(r"\d", lines[i - 1]) else line
        if 8 <= len(joined) <= 140 and re.search(subject, joined):
            return joined
    return None


def test_first_headings_equal_a_walk(spark):
    r = random.Random(8)
    lines = ["", "  ", "# Notice", "on fees", "Annex 3", "| a | b |", "> quote", "Rules for the use of rooms", "Rules " * 40, "short", "x\x0brules y of it", "12", "##", "notice of rules here\r"]
    texts = ["", "Rules", "Rules of 2024"] + ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.h for x in df.select("i", X.first_heading("t", "(?i)rules|notice", ["|", ">", "Annex"]).alias("h")).collect()}
    assert got == {i: plain_heading(t, "(?i)rules|notice", ["|", ">", "Annex"]) for i, t in enumerate(texts)}


def test_titles_by_their_evidence(spark):
    rows = [("Real heading", True, "Found", "old-Site X"), ("Welcome all", True, "Found", "old"), ("", True, None, "old-Site X"), (None, False, "Found", " old "), ("Welcome", None, "Found", None)]
    df = spark.createDataFrame(rows, "raw string, a boolean, h string, o string")
    got = [tuple(r.t) for r in df.select(X.evidence_title(F.col("raw"), "^Welcome", F.col("a"), F.col("h"), F.col("o"), "-Site.*$").alias("t")).collect()]
    assert got == [("Real heading", "raw_html_heading"), ("Found", "attachment_first_heading"), ("old", "legacy_title"), ("old", "legacy_title"), ("", "legacy_title")]


def test_titles_and_artifacts_are_normalised(spark):
    title = X.normalized_title(F.col("t"), r"20\d\d-\d\d-\d\d\s+", r"\s*(?:Published|Updated)[:：]", r"[-_—]\s*The Site.*$")
    rows = [("2024-01-02  Rules of 2024 - The Site News",), (" Rules Published: 2024 by x",), ("Updated: x",), (None,), ("2024-01-02",)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").select(title.alias("x")).collect()] == ["Rules of 2024", "Rules", "", None, "2024-01-02"]
    cases = [("# old\r\nbody\r\n\n\n\nend \n", "New", False), ("# old\nbody", "New", True), ("# old", "New", None), ("# old\nx", "", False), ("no head\n\n\n\nx", "New", False)]
    df = spark.createDataFrame(cases, "x string, t string, a boolean")
    assert [r.y for r in df.select(X.normalized_artifact("x", F.col("t"), F.col("a")).alias("y")).collect()] == ["# New\nbody\n\nend", "# old\nbody", "# New", "# old\nx", "no head\n\nx"]


def test_tables_equal_the_other_form(spark):
    from tessera.operators.html import table_markdown

    r = random.Random(3)
    tables = [[], [[]], [["a|b"], ["c", "d"]]] + [[[r.choice(["x", "a|b", " y ", "", "two\nlines", "p\r\nq"]) for _ in range(r.randrange(0, 4))] for _ in range(r.randrange(1, 5))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(tables)), "i int, rows array<array<string>>")
    got = {x.i: x.m for x in df.select("i", X.markdown_table(F.col("rows")).alias("m")).collect()}
    assert got == {i: table_markdown(t) if any(t) else "" for i, t in enumerate(tables)}


def test_clients_show_each_event_once_and_end(spark):
    from tessera.operators import wire

    known = {"run.started": "started", "message.delta": "text", "run.failed": "run_failed"}
    wires = [
        ("a", 0, 1, 1, "run.started"), ("a", 0, 2, 2, "message.delta"), ("a", 0, 3, 2, "message.delta"), ("a", 1, 1, 1, "run.started"), ("a", 1, 2, 3, "message.delta"), ("a", 1, 3, 4, "run.completed"), ("a", 1, 4, 5, "message.delta"),
        ("b", 0, 1, 1, "run.started"), ("b", 1, 1, 2, "unknown"), ("c", 3, 1, 1, "message.delta"), ("d", 0, 1, 1, "run.failed"),
    ]
    df = spark.createDataFrame(wires, "k string, attempt int, ord int, id long, event_type string")
    got = {}
    for r in wire.client_events(df, "k", known, ["run.completed", "run.failed"]).orderBy("k", "n").collect():
        got.setdefault(r.k, []).append((r.id, r.kind))
    assert got == {"a": [(1, "started"), (2, "text"), (3, "text")], "b": [(1, "started"), (None, "run_failed")], "c": [(None, "run_failed")], "d": [(1, "run_failed")]}


def test_checks_of_exports_caches_and_snapshots(spark):
    from tessera.operators import dedup, timetable

    e = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (2, "b", "y"), (3, "c", "z")], "id long, h string, lang string")
    f = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, h string")
    assert A.export_faults(e, f, "id", "h", ["lang"]).first().asDict() == {"duplicate_ids": 1, "duplicate_hashes": 1, "missing_files": 1, "hash_mismatches": 1, "missing_metadata": 1}
    c = spark.createDataFrame([("k", 5, "old"), ("k", 9, "new"), ("e", 1, "x")], "key string, expires_at int, answer string")
    q = spark.createDataFrame([("k",), ("e",), ("m",), (None,)], "key string")
    assert {r.key: (r.hit, r.entry and r.entry.answer) for r in dedup.cached(q, c, "key", F.lit(4)).collect()} == {"k": (True, "new"), "e": (False, "x"), "m": (False, None), None: (False, None)}
    assert not any(r.hit for r in dedup.cached(q, c, "key", F.lit(4), F.col("entry.answer") == "old").collect())
    t = spark.createDataFrame([("s", 1, "a", 1, 2), ("s", 1, "a", 3, 3), ("v", 1, "a", 1, 9), ("w", 1, "a", 2, 1), ("w", 2, "b", 1, 1)], "s string, id long, src string, a int, b int")
    got = {r.s: (r.repeated_ids, r.mixed_source, r.out_of_range, r.valid) for r in timetable.snapshot_faults(t, "s", "id", "src", F.col("a"), F.col("b"), 9).collect()}
    assert got == {"s": (1, False, 0, False), "v": (0, False, 0, True), "w": (0, True, 1, False)}
    rel = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 10)], "child_id long, parent_id long")
    ok = spark.createDataFrame([(10,), (11,)], "doc_id long")
    assert sorted(r.child_id for r in A.reviewed_attachments(rel, ok).collect()) == [1, 3]
    assert sorted(r.child_id for r in A.reviewed_attachments(rel, ok, spark.createDataFrame([(1, 11), (3, 12)], "child_id long, parent_id long")).collect()) == [1]
