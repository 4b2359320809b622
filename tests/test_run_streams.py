"""Streaming aggregates of runs: equal to the batch forms whatever the order of files, with
runs that cross windows, and without a call of Python for each run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_state import END, SECOND, batch, few_partitions, made, run, stream  # noqa: F401

from tessera.operators import events as E
from tessera.streaming import events as S


@pytest.mark.parametrize(("files", "seed"), [(1, 5), (6, 6)])
def test_states_by_windows(spark, tmp_path, few_partitions, files, seed):  # noqa: F811
    rows = made(seed)
    told = run(spark, tmp_path, S.run_parts(stream(spark, tmp_path, rows, files, seed), "100 seconds"), "update")
    assert told.groupBy("run_id").agg(F.count_distinct("start_us").alias("n")).agg(F.max("n")).first()[0] > 1
    got = {r.run_id: (r.state, r.events, r.code) for r in S.settled_runs(told, "400 seconds", "100 seconds").collect() if r.run_id != "last"}
    want = E.silent_runs(batch(spark, rows), F.lit(END - 100 * SECOND), 400 * SECOND)
    assert got == {r.run_id: (r.state, r.events, r.code) for r in want.collect()}
    assert got["silent"] == ("FAILED", 1, "server_restarted")
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/state").load()
    assert {r.key.run_id for r in kept.collect()} <= {"last"}


@pytest.mark.parametrize(("files", "seed"), [(1, 7), (6, 8)])
def test_first_terminals_by_windows(spark, tmp_path, few_partitions, files, seed):  # noqa: F811
    rows = made(seed)
    told = run(spark, tmp_path, S.first_terminals(stream(spark, tmp_path, rows, files, seed), "100 seconds"), "update")
    want = {}
    for r in rows:
        if r[5] in S.TERMINAL:
            want[r[4]] = min(want.get(r[4], r[2]), r[2])
    assert {r.run_id: r.sequence for r in S.settled_terminals(told).collect()} == want


@pytest.mark.parametrize("name", ["stream_run_state", "stream_terminal_once"])
def test_queries_keep_to_aggregates(name, spark, monkeypatch):
    from conftest import DATA
    from pyspark.sql.group import GroupedData

    from tessera.queries import QUERIES

    for method in ("transformWithState", "transformWithStateInPandas", "applyInPandasWithState"):
        monkeypatch.setattr(GroupedData, method, None)
    assert QUERIES[name](spark, DATA).count() > 0
