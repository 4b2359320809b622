"""Numbered appends, fan-out, token streams, store operations and the SQLite scan on inline cases."""

from __future__ import annotations

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import store, wire
from tessera.sources import sqlite


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_appended_numbers_follow_without_gaps(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    log = spark.createDataFrame([(7,), (40,)], "sequence long")
    got = wire.appended(log, spark.createDataFrame([(i,) for i in ids], "id long").repartition(5), ["id"])
    assert rows(got.select("id", "sequence")) == rows(spark.createDataFrame([(i, 41 + i) for i in ids], "id long, sequence long"))
    first = wire.appended(log.limit(0), spark.createDataFrame([(5,)], "id long"), ["id"])
    assert [r.sequence for r in first.collect()] == [1]
    assert wire.appended(log, spark.createDataFrame([], "id long"), ["id"]).count() == 0


@pytest.mark.parametrize("share", [0.35, 0.5, 0.8])
def test_fan_out_equals_plain_buffers(spark, share):
    rng = random.Random(int(share * 100))
    log = [(s, i, rng.random() < share) for s in ("a", "b", "c") for i in range(120)]
    want = []
    for s in ("a", "b", "c"):
        held, open_ = 0, True
        for _, i, published in [x for x in log if x[0] == s]:
            if not published:
                held = max(0, held - 1)
            elif open_ and held < 4:
                held += 1
                want.append((s, i))
            else:
                open_ = False
    rng.shuffle(log)
    got = wire.fan_out(spark.createDataFrame(log, "subscriber string, ord int, published boolean"), buffer=4)
    assert rows(got.where("delivered").select("subscriber", "ord")) == sorted(want, key=repr)


def lines(spark, *streams):
    return spark.createDataFrame([(k, i, x) for k, given in streams for i, x in enumerate(given)], "stream string, ord int, line string")


def piece(*texts):
    return 'data: {"choices": [' + ", ".join('{"delta": {"content": "%s"}}' % x for x in texts) + "]}"


def test_streams_end_at_their_mark_and_fail_without(spark):
    df = lines(
        spark,
        ("ok", [": hi", "", piece("A", "b"), piece(""), '  data: {"model": "m", "choices": [], "usage": {"prompt_tokens": 2, "completion_tokens": 3}} ', piece("c"), '{"no": "data"}', "data: [DONE]", piece("late")]),
        ("cut", [piece("A")]),
        ("bad", [piece("A"), "data: {oops", piece("B"), "data: [DONE]"]),
        ("list", ["data: [1]", "data: [DONE]"]),
        ("empty", ["data:", "data: [DONE]"]),
        ("none", ["event: ping"]),
        ("bare", ["data: [DONE]"]),
    )
    assert rows(wire.stream_results(df, "m0")) == rows(
        spark.createDataFrame(
            [("ok", "Abc", "m", 2, 3, ""), ("bare", "", "m0", 0, 0, "")] + [(k, None, None, None, None, e) for k, e in (("cut", "stream_incomplete"), ("none", "stream_incomplete"), ("bad", "invalid_stream"), ("list", "invalid_stream"), ("empty", "invalid_stream"))],
            "stream string, content string, model string, input_tokens long, output_tokens long, error string",
        )
    )
    assert rows(wire.stream_deltas(df).select("stream", "ord", "choice", "delta")) == [("bad", 0, 0, "A"), ("cut", 0, 0, "A"), ("ok", 2, 0, "A"), ("ok", 2, 1, "b"), ("ok", 5, 0, "c")]


def test_upsert_keeps_other_schools_and_what_is_not_stated(spark):
    kind = "id int, school int, name string"
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, None, "d")], kind)
    new = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 1, None), (4, None, "z"), (5, 9, "n")], kind)
    assert rows(store.upsert(old, new, "id", "school")) == [(1, 1, "x"), (2, 1, "b"), (3, 1, "c"), (4, None, "d"), (5, 9, "n")]


def test_shares_counts_owners_and_visible_sources(spark):
    df = spark.createDataFrame([("a", "QUEUED"), ("a", "DONE"), ("b", "DONE"), ("a", "DONE")], "who string, status string")
    assert rows(store.breakdown(df, F.col("who"))) == [("a", 3, 0.75), ("b", 1, 0.25)]
    assert rows(store.status_counts(df, ["who"], "status", ["QUEUED"])) == [("a", "DONE", 2, 2), ("a", "QUEUED", 1, 0), ("b", "DONE", 1, 1)]
    assert rows(store.owned(df, spark.createDataFrame([("a",), ("a",)], "who string"), "who").select("who")) == [("a",)] * 3
    users = spark.createDataFrame([(1, "s"), (2, "t"), (3, None)], "user_id int, school string")
    assert rows(store.visible(users, spark.createDataFrame([("s",), ("s",), (None,)], "school string"), "school")) == [(1, 2)]
    assert store.breakdown(df.limit(0), F.col("who")).collect() == []


def test_sqlite_scan_by_ranges_and_snapshot(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE "odd ""name" (id INTEGER PRIMARY KEY, t TEXT, x REAL, b BLOB)')
    db.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?)', [(i * 3, f"t{i}" if i % 4 else None, i / 2, bytes([i])) for i in range(100)])
    db.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    db.execute("INSERT INTO bare VALUES ('a', 1)")
    db.execute("CREATE TABLE vacant (k TEXT)")
    db.commit()
    sqlite.register(spark)
    read = lambda p, table: spark.read.format("sqlite_table").option("path", p).option("table", table).option("parts", "7").load()
    copy = sqlite.snapshot(path, str(tmp_path / "copy.db"))
    db.execute("DELETE FROM bare")
    db.commit()
    got = read(copy, 'odd "name')
    assert got.rdd.getNumPartitions() == 7
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double", "binary"]
    assert sorted((r.id, r.t, r.x, bytes(r.b)) for r in got.collect()) == [(i * 3, f"t{i}" if i % 4 else None, i / 2, bytes([i])) for i in range(100)]
    assert rows(read(copy, "bare")) == [("a", 1)] and rows(read(path, "bare")) == [] and rows(read(path, "vacant")) == []
    with pytest.raises(FileExistsError):
        sqlite.snapshot(path, copy)
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(path).execute("DELETE FROM bare")
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(str(tmp_path / "missing.db"))
    assert sorted(os.listdir(tmp_path)) == ["a.db", "copy.db"]
