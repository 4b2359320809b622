"""Intermediate folders, strict JSON lines, week labels, extras and bounded office files."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import admission as A
from tessera.operators import timetable as T
from tessera.queries import QUERIES
from tessera.sources import files
from tessera.sources.tables import checkpoint_folder, read_jsonl, scope, settle

DATA = "/root/testdata/sf0.001"


def held(spark):
    base = checkpoint_folder(spark).removeprefix("file:")
    return {f"{d}/{x}" for d in ("settled", "streams") if os.path.isdir(f"{base}/{d}") for x in os.listdir(f"{base}/{d}")}


def test_scopes_remove_what_was_settled_in_them(spark):
    before = held(spark)
    with scope(spark):
        outer = settle(spark.range(5))
        with scope(spark):
            inner = settle(spark.range(3))
            assert inner.count() == 3 and len(held(spark) - before) == 2
        assert outer.count() == 5 and len(held(spark) - before) == 1
    assert held(spark) == before
    with pytest.raises(RuntimeError), scope(spark):
        settle(spark.range(2))
        raise RuntimeError
    assert held(spark) == before
    kept = settle(spark.range(7))
    assert kept.count() == 7 and len(held(spark) - before) == 1


@pytest.mark.parametrize("name", ["capped_extras", "run_quality", "stream_tumbling"])
def test_queries_leave_nothing_behind(spark, name):
    before = held(spark)
    with scope(spark):
        assert QUERIES[name](spark, DATA).count() > 0
        assert held(spark) > before
    assert held(spark) == before


def test_broken_lines_fail_unless_they_may(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n   \n{"a": 2\n{"a": 3}\n')
    schema = StructType.fromDDL("a int")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path), schema).collect()
    assert sorted(str(r.a) for r in read_jsonl(spark, str(tmp_path), schema, strict=False).collect()) == ["1", "3", "None"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 3}\n')
    assert sorted(r.a for r in read_jsonl(spark, str(tmp_path), schema).collect()) == [1, 3]


@pytest.mark.parametrize(("weeks", "want"), [([], "无上课周次"), ([3], "3周"), ([2, 1, 2, 3, 7], "1–3、7周"), ([5, 1, 3], "1–5周（单）"), ([2, 4, 6], "2–6周（双）"), ([1, 3], "1、3周"), ([1, 3, 4], "1、3–4周")])
def test_week_labels(spark, weeks, want):
    assert spark.range(1).select(T.week_label(F.array(*map(F.lit, weeks)).cast("array<int>")).alias("l")).first().l == want


def test_extras_are_the_latest_for_a_question(spark):
    docs = spark.createDataFrame([(i, "t", i) for i in range(10)], "id long, topic string, n long")
    cover = spark.createDataFrame([("t", 9)], "topic string, id long")
    latest = spark.createDataFrame([(f"q{i}", i) for i in (9, 8, 5, 5, 2, 0)], "tag string, latest_id long")
    got = A.capped_extras(docs, cover, latest, "topic", "id", [F.desc("n")], F.lit(4), 12)
    assert sorted((r.kind, r.id) for r in got.collect()) == [("cover", 9), ("extra", 2), ("extra", 5), ("extra", 8)]


def test_office_files_beyond_the_budget_are_not_inflated():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"<x>" + b" " * 5_000_000 + b"</x>")
    assert files.file_text("a.docx", out.getvalue()) == ("", "parse_failure")
    assert files.file_text("a.xlsx", out.getvalue()) == ("", "parse_failure")


def test_extras_may_be_wanted_for_another_reason(spark):
    docs = spark.createDataFrame([(i, "t" if i % 2 else "u", i, "c" if i > 3 else None) for i in range(10)], "id long, topic string, n long, college string")
    cover = spark.createDataFrame([("t", 9)], "topic string, id long")
    latest = spark.createDataFrame([("q", 8), ("r", 1)], "tag string, latest_id long")
    also = (F.col("topic") == "t") & F.col("college").isNotNull()
    got = A.capped_extras(docs, cover, latest, "topic", "id", [F.desc("n")], F.lit(4), 12, also)
    assert sorted((r.kind, r.id) for r in got.collect()) == [("cover", 9), ("extra", 1), ("extra", 5), ("extra", 7), ("extra", 8)]
