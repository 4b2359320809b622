"""Streams with keyed state and timers: equal to the batch forms whatever the order of files,
and with nothing left in their state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.streaming import state as ST

SECOND = 1_000_000
END = 10_000 * SECOND
SCHEMA = "user_id long, key string, sequence long, at_us long, run_id string, event_type string"
KINDS = ["route.resolved", "message.delta", "message.completed", "run.completed", "run.failed", "run.cancelled"]


def made(seed, n=600):
    r = random.Random(seed)
    at = sorted(r.randrange(0, 3000) * SECOND // 10 for _ in range(n))
    rows = [(r.randrange(6), r.choice("abc"), i, t, f"run{r.randrange(25)}", r.choices(KINDS, [6, 6, 3, 1, 1, 1])[0]) for i, t in enumerate(at)]
    # a run without an end that falls silent, and one that goes on until late
    rows += [(7, "a", 9001, 5 * SECOND, "silent", "message.delta"), (7, "a", 9002, 290 * SECOND, "open", "message.delta")]
    return rows


def stream(spark, tmp_path, rows, files, seed):
    """Rows dealt over files within the lateness of 100 s, then one far ahead: all that came
    before is passed by the watermark."""
    r = random.Random(seed)
    path = f"{tmp_path}/in"
    shuffled = sorted(rows, key=lambda x: x[3] + r.randrange(0, 90 * SECOND))
    size = -(-len(shuffled) // files)
    for part in [*(shuffled[i : i + size] for i in range(0, len(shuffled), size)), [(99, "z", 10_000, END, "last", "route.resolved")]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return s.withColumn("created_at", F.timestamp_micros("at_us"))


def run(spark, tmp_path, df, mode):
    out = f"{tmp_path}/out"
    with ST.rocksdb(spark):
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def left(spark, tmp_path, name):
    return spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", name).load()


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("files", "seed"), [(1, 1), (5, 2)])
def test_reservations(spark, tmp_path, few_partitions, files, seed):
    rows = made(seed)
    got = run(spark, tmp_path, ST.reservations(stream(spark, tmp_path, rows, files, seed), ["user_id", "key"], 20 * SECOND, "100 seconds"), "append")
    want = E.idempotent(batch(spark, rows), ["user_id", "key"], 20 * SECOND, "at_us")
    key = lambda df: sorted((r.user_id, r.key, r.sequence, r.reserved) for r in df.collect())
    assert key(got) == key(want) and len({r[3] for r in key(want)}) == 2
    assert left(spark, tmp_path, "state").count() == 0
    assert {r.key.user_id for r in left(spark, tmp_path, "pending").collect()} <= {99}


@pytest.mark.parametrize(("files", "seed"), [(1, 3), (4, 4)])
def test_logins(spark, tmp_path, few_partitions, files, seed):
    rows = made(seed)
    got = run(spark, tmp_path, ST.logins(stream(spark, tmp_path, rows, files, seed), 3, 15 * SECOND, "100 seconds"), "append")
    want = E.login_limit(batch(spark, rows), 3, 15 * SECOND)
    key = lambda df: sorted((r.user_id, r.sequence, r.at_us, r.allowed) for r in df.collect())
    assert key(got) == key(want) and len({r[3] for r in key(want)}) == 2
    assert left(spark, tmp_path, "state").count() == 0


@pytest.mark.parametrize(("files", "seed"), [(1, 5), (6, 6)])
def test_runs_end_by_an_event_or_by_silence(spark, tmp_path, few_partitions, files, seed):
    rows = made(seed)
    told = run(spark, tmp_path, ST.run_states(stream(spark, tmp_path, rows, files, seed), "400 seconds", "100 seconds"), "update")
    got = {r.run_id: (r.state, r.events, r.code) for r in ST.settled_states(told).collect() if r.run_id != "last"}
    want = E.silent_runs(batch(spark, rows), F.lit(END - 100 * SECOND), 400 * SECOND)
    assert got == {r.run_id: (r.state, r.events, r.code) for r in want.collect()}
    assert got["silent"] == ("FAILED", 1, "server_restarted")
    assert [r.key.run_id for r in left(spark, tmp_path, "run").collect()] == ["last"]


def test_a_run_is_open_until_its_silence_is_over(spark):
    rows = made(7)
    early = {r.run_id: r.code for r in E.silent_runs(batch(spark, rows), F.lit(300 * SECOND), 100 * SECOND).collect()}
    assert early["silent"] == "server_restarted" and early["open"] is None
