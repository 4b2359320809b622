"""Operators against small inline cases and plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import admission, dedup, events, html, retrieval, rules, timetable
from tessera.operators.folds import fold
from tessera.sources.tables import extends, read_jsonl, with_views, write_jsonl


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def texts(spark, rows, name="x"):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


@pytest.mark.parametrize(("given", "want"), [
    ("HTTPS://Jwc.Example.EDU.cn:443//a//b?utm_source=x&b=2&a=1#top", "https://jwc.example.edu.cn/a/b?a=1&b=2"),
    ("http://example.edu.cn", "http://example.edu.cn/"),
    ("http://example.edu.cn:8080/a?x=", "http://example.edu.cn:8080/a"),
    ("mailto:a@b", "mailto:a@b"), ("", ""), (None, ""),
])
def test_canonical(spark, given, want):
    assert texts(spark, [given]).select(U.canonical("x")).first()[0] == want


def test_gate_reasons(spark):
    cases = {"https://a.edu.cn/x": "ok", "https://a.edu.cn/login": "forbidden_path", "https://10.0.0.1/": "private_or_internal_host", "https://b.org/": "offsite_candidate_only", "https://no.edu.cn/": "forbidden_domain", "https://u@a.edu.cn/": "userinfo_not_allowed", "https://a.edu.cn/i.png": "unsupported_extension", "javascript:x": "unsupported_scheme", "https://a.edu.cn:99999/": "invalid_url", "": "empty_url"}
    g = U.gate(texts(spark, list(cases), "url"), "url", domains=["edu.cn"], denied=["no.edu.cn"], patterns=["/login"], inactive=F.lit(False), depth=F.lit(0), max_depth=3)
    assert {r.url: r.reason for r in g.collect()} == cases


def test_broadest_drops_both_copies(spark):
    row = one(spark, U.broadest(F.array(*[F.lit(x) for x in ("a.b", "x", "a.b", "c.x")])).alias("b"))
    assert row.b == ["x"]


def test_canonical_text_all_spaces(spark):
    assert texts(spark, [" a　b\x1c\n c "]).select(X.canonical_text("x")).first()[0] == "a b c"


def test_id_card_checksum(spark):
    good, bad = "11010519491231002X", "110105194912310021"
    got = texts(spark, [f"id {good} and {bad}", f"1{good}", ""]).select(rules.id_cards(F.col("x")).alias("i")).collect()
    assert [r.i for r in got] == [[good], [], []]


def test_pii_roster_and_phones(spark):
    rows = [("13800138000 13900139000 13700137000", "t"), ("13800138000", "录取名单"), ("13800138000", "t"), ("学号：20210001", "t"), (None, None)]
    df = spark.createDataFrame(rows, "text string, title string")
    got = rules.pii(df, "text", "title").select("pii_risk", "pii_categories").collect()
    assert [r.pii_risk for r in got] == ["MEDIUM", "MEDIUM", "NONE", "HIGH", "NONE"]


def test_content_role_order_and_exemption(spark):
    cases = {"关于做好报名工作座谈会": "UNKNOWN", "学校召开会议": "NEWS", "拟录取名单": "RESULT_ANNOUNCEMENT", "转专业管理办法": "POLICY_REGULATION", "采购公告": "NON_STUDENT", "放假通知": "ANNUAL_NOTICE"}
    got = {r.x: r.c for r in texts(spark, list(cases)).select("x", rules.content_role(F.col("x")).alias("c")).collect()}
    assert got == cases


@pytest.mark.parametrize(("given", "want"), [("你好，请问转专业怎么办", "转专业怎么办"), ("你好像很忙", "你好像很忙"), ("helloWorld", "helloWorld"), ("Hello, 选课", "选课"), ("你好", ""), ("请问：校历", "校历"), ("请帮我查一下，想问一下选课", "选课"), ("您好呀！嗨 选课", "选课")])
def test_question_strip(spark, given, want):
    assert texts(spark, [given]).select(retrieval.stripped(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(("given", "want"), [("选课开始了吗", "freshness_status_question"), ("最新校历", "freshness_current_marker"), ("2026年校历", "freshness_current_year"), ("2023年奖学金", "historical_explicit_year"), ("什么时候放假", "freshness_schedule_question"), ("报名条件", "freshness_dynamic_information"), ("图书馆在哪里", "stable_campus_knowledge")])
def test_freshness(spark, given, want):
    assert texts(spark, [given]).select(retrieval.freshness(F.col("x"), 2026).alias("f")).first().f.reason == want


@pytest.mark.parametrize(("given", "reason", "route"), [("你好！", "pure_social", "controlled"), ("hi，你是谁？", "product_introduction", "controlled"), ("官网搜索测试", "integration_probe", "web_search"), ("请问最新校历", "freshness_current_marker", "hybrid"), ("请问图书馆在哪里", "stable_campus_knowledge", "knowledge"), ("请问", "stable_campus_knowledge", "knowledge")])
def test_profile_and_route(spark, given, reason, route):
    p = texts(spark, [given]).select(retrieval.profile(F.col("x"), 2026).alias("p"))
    r = p.select("p.*", retrieval.route(F.col("p.level"), F.col("p.social"), F.col("p.introduction"), F.col("p.probe")).alias("route")).first()
    assert (r.reason, r.route) == (reason, route) and (r.effective != "" or r.social)


def test_query_terms(spark):
    got = texts(spark, ["  Library opening hours "]).select(retrieval.query_terms(F.col("x")).alias("t")).first().t
    assert got[:4] == ["library opening hours", "library", "li", "ib"] and len(got) == len(set(got))
    assert texts(spark, ["a"]).select(retrieval.query_terms(F.col("x")).alias("t")).first().t == []


def test_latest_salted_equals_plain(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 11).alias("v"), "id")
    by = [F.desc("v"), F.desc("id")]
    a, b = (sorted(r.id for r in dedup.latest(df, "k", by, salt=s).where("kept").collect()) for s in (0, 8))
    assert a == b and len(a) == 3


def test_greedy_cover_matches_plain_python(spark):
    rows = [("t", i, ["abc", "ab", "c", "d", "abcd"[i % 4]][i % 5], i * 37 % 10) for i in range(20)]
    df = spark.createDataFrame([(t, i, list(x), s) for t, i, x, s in rows], "topic string, id long, tags array<string>, score long")
    got = [(r.id, r.gain) for r in admission.greedy_cover(df, "topic", "id", "tags", ["score"]).orderBy("pick").collect()]
    left, want = set("abcd"), []
    while left:
        best = max(rows, key=lambda r: (len(left & set(r[2])), r[3], r[1]))
        want.append((best[1], len(left & set(best[2]))))
        left -= set(best[2])
    assert got == want


def test_orphans_cycle_and_unknown_parent_stay(spark):
    docs = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True), (5, True), (6, True), (7, True)], "doc_id long, is_attachment boolean")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "child_id long, parent_id long")
    gone = admission.prune_orphans(docs, edges, spark.createDataFrame([(1,)], "doc_id long"))
    assert sorted(r.doc_id for r in gone.collect()) == [2, 3, 7]


def test_fold_keeps_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
        got = fold(df, ["k"], ["id"], lambda: [0], lambda s, r: s.__setitem__(0, s[0] + 1) or s[0], "n", "long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.n == r.id // 3 + 1 for r in got)


def test_login_window(spark):
    us = 1_000_000
    df = spark.createDataFrame([(1, i, t * us) for i, t in enumerate([0, 1, 2, 59, 60, 61])], "user_id long, sequence long, at_us long")
    got = [r.allowed for r in events.login_limit(df, 3).orderBy("sequence").collect()]
    assert got == [True, True, True, False, True, True]


def test_pressure(spark):
    def factors(outcomes, *limits):
        df = spark.createDataFrame([("h", i, s == 200, s or None) for i, s in enumerate(outcomes)], "host string, sequence long, ok boolean, status int")
        return [r.factor for r in events.host_pressure(df, *limits).orderBy("sequence").collect()]

    assert factors([503, 500, 200, 200, 429], 2, 4.0, 2) == [1.0, 4.0, 4.0, 1.0, 1.0]
    # a failure that is no pressure keeps the streak, and ends the calm
    assert factors([503, 404, 503, 200, 0, 200, 200], 2, 4.0, 2) == [1.0, 1.0, 4.0, 4.0, 4.0, 4.0, 1.0]
    assert factors([404] * 6, 2, 4.0, 2) == [1.0] * 6


def sent(deltas, size, tick):
    """Flushes of one run by a loop over its deltas and its ticks."""
    out, pending, start, due = [], [], deltas[0][1], deltas[0][1] + tick
    for sequence, at, text in deltas:
        while at >= due:
            if pending:
                out.append(pending)
                pending = []
            due += tick
        if text:
            pending = [*pending, (sequence, text)]
        if sum(len(t.encode()) for _, t in pending) >= size:
            out.append(pending)
            pending = []
    return [("".join(t for _, t in p), p[0][0]) for p in [*out, *([pending] if pending else [])]]


def test_deltas_are_coalesced_by_bytes_and_ticks(spark):
    import random

    r = random.Random(4)
    runs = {"gaps": [(i, 100 * i, "abcde") for i in range(10)], "bytes": [(0, 0, "é" * 60), (1, 1, "é" * 60)], "reset": [(i, i, "x" * 70) for i in range(4)], "exact": [(0, 0, "x" * 96), (1, 120, "y"), (2, 239, "z"), (3, 240, "w")]}
    for k in range(60):
        at = 0
        runs[f"r{k}"] = [(i, at := at + r.choice([0, 1, 30, 119, 120, 121, 500]), "aé漢"[r.randrange(3)] * r.choice([0, 1, 5, 40, 96, 97, 200])) for i in range(40)]
    df = spark.createDataFrame([(k, *d) for k, v in runs.items() for d in v], "run_id string, sequence long, at_ms long, delta string").withColumn("from_ms", F.min("at_ms").over(Window.partitionBy("run_id")))
    got = {}
    for x in events.coalesce_deltas(df, start_ms="from_ms").orderBy("run_id", "tick", "flush").collect():
        got.setdefault(x.run_id, []).append((x.text, x.first_sequence))
        assert x.bytes == len(x.text.encode())
    assert got == {k: sent(v, 96, 120) for k, v in runs.items() if any(t for *_, t in v)}
    assert [len(t) for t, _ in got["bytes"]] == [60, 60] and [len(t) for t, _ in got["reset"]] == [140, 140]


def test_pool_is_exhausted_after_its_last_model(spark):
    def used(errors):
        df = spark.createDataFrame([("p", i, e) for i, e in enumerate(errors)], "pool string, sequence long, error string")
        return [(r.model, r.failure) for r in events.model_cursor(df, 2, ["ModelNotFound"]).orderBy("sequence").collect()]

    gone = (None, "model_pool_exhausted")
    assert used([" modelnotfound ", "timeout", "MODELNOTFOUND", None, "x"]) == [(0, None), (1, None), (1, None), gone, gone]
    assert used(["ModelNotFound"] * 4) == [(0, None), (1, None), gone, gone]
    assert used(["rate_limit", None, "rate_limit"]) == [(0, None)] * 3


def test_final_text_unless_it_is_empty(spark):
    rows = [("a", 1, "delta", "x"), ("a", 2, "delta", "y"), ("a", 3, "final", ""), ("b", 1, "delta", "x"), ("b", 2, "final", "z"), ("c", 1, "other", "q"), ("d", 1, "final", "old"), ("d", 2, "final", ""), ("d", 3, "delta", "new")]
    df = spark.createDataFrame(rows, "run_id string, sequence long, kind string, text string")
    assert {r.run_id: r.answer for r in events.rebuild_answer(df).collect()} == {"a": "xy", "b": "z", "c": "", "d": "new"}


def test_mentions_overlap(spark):
    import re

    texts = ["due 2024-05-06 and 2024-06-07 end", "", None, "2024-01-01", "é😀 2024-01-02" + "x" * 200 + "2024-01-03", "2024-01-01 " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(m.text, m.context) for m in r.m or []] for r in df.select("i", X.mentions("t", r"\d{4}-\d\d-\d\d").alias("m")).collect()}
    want = {i: [(m[0], t[max(0, m.start() - 45) : m.end() + 65]) for m in re.finditer(r"\d{4}-\d\d-\d\d", t or "")][:40] for i, t in enumerate(texts)}
    assert got == want and len(got[0]) == 2


def test_sse(spark):
    cases = {"id: 1\nevent: a\ndata: {\"x\":\ndata: 1}\n\n": '{"x":\n1}', ": ping\n\n": None, "data: {oops\n\n": None}
    got = {r.x: r.p.data if r.p else None for r in texts(spark, list(cases)).select("x", events.sse_parse(F.col("x")).alias("p")).collect()}
    assert got == cases


def test_week_bitmap_and_ranges(spark):
    got = texts(spark, ["0110", "10x", "1" * 65, ""]).select(timetable.week_bitmap(F.col("x")).alias("w")).collect()
    assert [r.w for r in got] == [[2, 3], None, None, []]
    weeks = spark.createDataFrame([(k, w) for k, ws in {1: [1, 2, 3, 7], 2: [1, 3, 5], 3: [2, 4], 4: [9]}.items() for w in ws], "k int, week int")
    assert {r.k: r.label for r in timetable.week_ranges(weeks, "k").collect()} == {1: "1–3、7周", 2: "1–5周（单）", 3: "2、4周", 4: "9周"}


def test_lanes(spark):
    c = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 2, 3), (1, 3, 4, 5), (1, 4, 6, 7)], "day long, id long, start int, end int")
    got = {r.id: (r.lane, r.lane_count) for r in timetable.lanes(c, "day").collect()}
    assert got == {1: (0, 2), 2: (1, 2), 3: (1, 2), 4: (0, 1)}


def test_decode():
    assert html.decode("中文".encode("gb18030"))[0] == "中文"
    assert html.decode("﻿x".encode())[0] == "x"
    assert html.decode(b"<meta charset=gbk>" + "中".encode("gbk"))[1] == "gbk"


def test_jsonl_round_trip_and_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, read_jsonl(spark, str(tmp_path / "j"), df.schema).collect()), key=str) == [(1, "a"), (2, None)]
    assert extends(df.schema, spark.range(1).schema) == ["dropped:s"]


def test_with_views_orders_dependencies():
    sql = with_views("SELECT * FROM agent_runs")
    assert sql.index("run_events AS") < sql.index("agent_runs AS")


def test_contains_join_ways_agree(spark):
    from tessera.operators.search import contains_join

    t = spark.createDataFrame([(1, "a b c d e f g h"), (2, "xa b c d e f gx"), (3, "a b"), (4, "")], "doc_id long, body string")
    p = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c"), (3, "a b c d e f gx"), (4, "q r s t u v w")], "item long, needle string")
    ways = [sorted((r.doc_id, r.item) for r in contains_join(t, p, "doc_id", "body", "needle", few=n).collect()) for n in (100, 1)]
    assert ways[0] == ways[1] == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_files_docx_xlsx(tmp_path):
    import io
    import zipfile

    from tessera.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr></w:tbl></w:body></w:document>")
    assert files.file_text("x.DOCX", doc.getvalue()) == ("Hello you\n\n| a | b\\|c |\n| --- | --- |", "")
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>')
    assert files.file_text("b.xlsx", book.getvalue())[0] == "## S\n\n| one |  | 3 |\n| --- | --- | --- |"
    assert files.file_text("b.xlsx", b"x") == ("", "parse_failure") and files.file_text("p.pdf", b"")[1] == "unsupported_or_image"


def test_package_is_verified(tmp_path):
    import zipfile

    from tessera.sources import files

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("a")
    out = str(tmp_path / "p.zip")
    assert list(files.package(str(tmp_path / "d"), out)) == ["a.txt"] and files.verify_package(out) == []
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("new", "x")
    assert files.verify_package(out) == ["new"]
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("rows.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert files.jsonl_member(open(out, "rb").read(), ".jsonl") == [{"a": 1}, {"a": 2}]


def test_paged_source(spark, tmp_path):
    import json

    from tessera.sources import files

    for p in (1, 2, 3):
        (tmp_path / f"{p}.json").write_text(json.dumps({"total": 7, "items": [{"id": i} for i in range((p - 1) * 3, min(7, p * 3))]}))
    files.register(spark)
    read = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{page}}.json").option("pageSize", "3")
    assert sorted(r.id for r in read.load().collect()) == [str(i) for i in range(7)]
    assert sorted(r.id for r in read.option("limit", "4").load().collect()) == ["0", "1", "2", "3"]


def test_contains_join_many_short_passages(spark):
    from tessera.operators.search import contains_join

    import random

    r = random.Random(6)
    texts_ = [(i, " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(12))) for i in range(40)] + [(99, "")]
    needles = sorted({t[a : a + n] for _, t in texts_ for n in (1, 2, 3, 5, 9, 17, 30) for a in (0, 4, 11)} | {"zz", "a  b", ""})
    t = spark.createDataFrame(texts_, "doc_id long, body string")
    p = spark.createDataFrame(list(enumerate(needles)), "item long, needle string")
    got = sorted((x.doc_id, x.item) for x in contains_join(t, p, "doc_id", "body", "needle", few=0).collect())
    assert got == sorted((d, i) for d, b in texts_ for i, n in enumerate(needles) if n in b)


@pytest.mark.parametrize("files", [1, 6])
def test_terminal_once_over_files_out_of_order(spark, tmp_path, files):
    """The least terminal sequence counts, whichever file brings it."""
    import random

    from tessera.streaming import events as S

    rows = [(f"r{i % 7}", 1000 - i, "run.completed" if i % 3 else "run.failed", 1_700_000_000 + i * 30) for i in range(90)] + [("only", 5, "message.delta", 1_700_000_000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, sequence long, event_type string, at long").withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    for n in range(files):
        df.where(F.pmod(F.xxhash64("sequence"), F.lit(files)) == n).coalesce(1).write.parquet(str(tmp_path / "e.parquet"), mode="append")
    stream = S.source(spark, str(tmp_path), "e", files_per_trigger=1)
    got = S.settled_terminals(S.run_to_end(S.terminal_once(stream), f"t{files}", "append"))
    want = {}
    for run, sequence, kind, _ in rows:
        if kind in S.TERMINAL:
            want[run] = min(want.get(run, sequence), sequence)
    assert {x.run_id: x.sequence for x in got.collect()} == want


def test_archive_rules(spark):
    import io
    import warnings
    import zipfile

    from tessera.sources import files

    warnings.simplefilter("ignore")

    def pack(*names, size=1):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            for n in names:
                z.writestr(n, "x" * size)
        return f.getvalue()

    cases = {"ok": (pack("a", "d/b"), ""), "up": (pack("a", "d/../../b", "a"), "unsafe_archive_member:d/../../b"), "root": (pack("/a"), "unsafe_archive_member:/a"), "drive": (pack("C:a"), "unsafe_archive_member:C:a"), "twice": (pack("a", "b", "a", "../c"), "duplicate_archive_member:a"), "many": (pack(*map(str, range(5))), "archive_budget_exceeded"), "large": (pack("a", size=200), "archive_budget_exceeded"), "none": (b"no", "not_an_archive"), "dots": (pack("a..b", "..c"), "")}
    df = spark.createDataFrame([(k, bytearray(c)) for k, (c, _) in cases.items()], "path string, content binary")
    assert {r.path: r.fault for r in files.archive_contract(df, members=4, total=100).collect()} == {k: f for k, (_, f) in cases.items()}


def test_spans_and_tables():
    assert html.expand([[("a", 3, 1), ("b", 1, 2)], [("c", 1, 1)], [("d", 1, 1), ("e", 1, 1)]]) == [["a", "b", "b"], ["a", "c", ""], ["a", "d", "e"]]
    assert html.expand([]) == [] and html.expand([[]]) == [] and html.expand([[("x", 200, 2)]]) == [["x", "x"]]
    assert html.table_markdown([["a|b"], ["c", "d"]]) == "| a\\|b |  |\n| --- | --- |\n| c | d |" and html.table_markdown([]) == ""


def test_plan_lines():
    from tessera.operators import config

    plans = {"a": {"k": 1, "reviews": [1], "context_decisions": [{"document_id": d} for d in "xyz"], "drop_context_documents": ["z"]}, "b": {"extends": "a", "reviews": [2], "drop_context_documents": ["x"], "context_decisions": [{"document_id": "q"}]}, "c": {"extends": "b", "k": 3, "drop_context_documents": ["y"]}, "l": {"extends": "l"}}
    assert config.lineage(plans, "c") == ["a", "b", "c"]
    got = config.extended(plans, "c")
    assert got["k"] == 3 and got["reviews"] == [1, 2] and got["context_decisions"] == [{"document_id": "z"}] and "extends" not in got
    assert config.extended(plans, "a") == plans["a"]
    with pytest.raises(ValueError):
        config.lineage(plans, "l")


def test_windows_and_plans():
    import datetime as dt

    from tessera.operators import config

    now = dt.datetime(2026, 1, 15, 20, tzinfo=dt.timezone.utc)
    a, b = config.report_window("2026-01-01", "2026-01-02", "Asia/Shanghai", now)
    assert (a.isoformat(), b.isoformat()) == ("2025-12-31T16:00:00+00:00", "2026-01-02T16:00:00+00:00")
    assert config.report_window("", "", "UTC", now)[0] == now - dt.timedelta(days=7)
    with pytest.raises(ValueError):
        config.report_window("2025-01-01", "2026-01-01", "UTC", now)
    assert config.preset(7, now, "Asia/Shanghai") == ("2026-01-10", "2026-01-16")
    assert [config.range_fault(*x) for x in (("2026-01-01", "2026-01-01"), ("2026-01-02", "2026-01-01"), ("2025-01-01", "2026-01-01"), ("x", "2026-02-30"))] == ["", "reversed", "too_long", "missing"]
    plans = {"a": {"k": 1, "reviews": [1], "context_decisions": [{"document_id": "x"}, {"document_id": "y"}]}, "b": {"extends": "a", "k": 2, "reviews": [2], "drop_context_documents": ["x"]}}
    got = config.extended(plans, "b")
    assert got["k"] == 2 and got["reviews"] == [1, 2] and got["context_decisions"] == [{"document_id": "y"}]


def test_evidence_and_quotes_ignore_white_space(spark):
    import re

    rows = [("x  ab\u3000c y", "a bc"), ("a.b*c", ". b *"), ("ab", "b a"), ("", "a"), ("abc", ""), (None, "a"), ("😀 \\E q", "😀\\ E"), ("y" * 150 + " a b " + "z" * 150, "ab"), ("aba b", "ab")]
    loose = lambda n: r"\s*".join(re.escape(c) for c in re.sub(r"\s+", "", n))

    def window(x, n):
        x = " ".join((x or "").split())
        m = re.search(loose(n), x)
        return m and x[max(0, m.start() - 100) : m.end() + 100]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, n string")
    got = [r.e for r in df.select("i", X.evidence_window("x", "n").alias("e")).orderBy("i").collect()]
    assert got == [window(*r) for r in rows]
    quotes = [("p the  end o\nf it of", "th e", "of", "the end o f"), ("the", "the", "he", "the"), ("of the", "the", "of", None), ("a b", "x", "b", None), ("abcd", "abc", "bcd", "abcd"), (None, "a", "b", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(quotes)], "i int, x string, a string, b string, want string")
    assert all(r.q == r.want for r in df.select("want", X.quote_span("x", F.col("a"), F.col("b")).alias("q")).collect())


def test_unseen_events(spark):
    rows = [("r", 1, 5), ("r", 2, 4), ("r", 3, 5), ("r", 4, 7), ("q", 1, 1), ("q", 2, None), ("q", 3, 2)]
    got = events.unseen(spark.createDataFrame(rows, "run string, ord int, id int"), "run", "id", ["ord"])
    assert sorted((r.run, r.id) for r in got.collect()) == [("q", 1), ("q", 2), ("r", 5), ("r", 7)]
