"""Keyed state with timers: ordered folds over streams, and runs that end by themselves.

What depends on the order of events can't be told when a row comes, as earlier ones may come
later. Rows therefore wait in the state of their key until the watermark has passed them;
a timer then folds them in order of event time, with the same step as the batch form in
operators/. A second timer lets a key's state go once it no longer matters, so state doesn't
grow with the number of keys ever seen. The session needs the RocksDB state store
(rocksdb() sets it)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.events import TERMINAL, login_step, reservation_step, state_name

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Ordered(StatefulProcessor):
    """Folds the rows of a key in order of (at_us, order) as the watermark passes them."""

    def __init__(self, columns: list[str], fields: str, at: str, order: str, step: Callable[[dict, tuple], object], until: Callable[[dict], int | None], name: str) -> None:
        self.columns, self.fields, self.step, self.until = columns, fields, step, until
        self.row = Row(*columns, name)
        self.sort = (columns.index(at), columns.index(order))

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.pending = handle.getListState("pending", self.fields)
        self.state = handle.getValueState("state", "state string")

    def _later(self, due_us: int, now_ms: int) -> None:
        self.handle.registerTimer(max(-(-due_us // 1000), now_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        new = [tuple(r)[: len(self.columns)] for r in rows]
        self.pending.appendList(new)
        self._later(min(r[self.sort[0]] for r in new), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.pending.get()]
        ready = sorted((r for r in held if r[self.sort[0]] <= now * 1000), key=lambda r: (r[self.sort[0]], r[self.sort[1]]))
        rest = [r for r in held if r[self.sort[0]] > now * 1000]
        before = self.state.get()
        state = json.loads(before[0]) if before is not None else {}
        out = [self.row(*r, self.step(state, r)) for r in ready]
        if ready:
            self.pending.put(rest) if rest else self.pending.clear()
        until = self.until(state) if state else None
        if not rest and until is not None and until <= now * 1000:
            if before is not None:
                self.state.clear()
        else:
            if ready:
                self.state.update((json.dumps(state),))
            due = min((int(r[self.sort[0]]) for r in rest), default=until)
            if due is not None:
                self._later(int(due), now)
        return iter(out)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, keys: list[str], at: str, order: str, event_time: str, late: str, step: Callable[[dict, tuple], object], until: Callable[[dict], int | None], name: str, kind: str) -> DataFrame:
    """The stream df with one more column: for each row, in order of (at, order) within its
    key, what step(state, row) returns; state is a dict of what JSON holds, row the columns
    of df but for event_time. at: microseconds of event_time, a timestamp; rows come out once
    the watermark (late) has passed them, and rows later than that are dropped. until(state):
    the microsecond from which an empty state would do as well (None: never)."""
    columns = [c for c in df.columns if c != event_time]
    df = df.select(*columns, event_time)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    rows = df.withWatermark(event_time, late)
    processor = _Ordered(columns, fields, at, order, step, until, name)
    return rows.groupBy(*keys).transformWithState(processor, f"{fields}, `{name}` {kind}", "Append", "EventTime")


def reservations(events: DataFrame, keys: list[str], ttl_us: int, late: str) -> DataFrame:
    """Stream form of operators.events.idempotent: events have keys, sequence, at_us and
    created_at. A key's state is let go when its reservation has run out."""
    df = events.select(*keys, "sequence", "at_us", "created_at")
    return fold_stream(df, keys, "at_us", "sequence", "created_at", late, reservation_step(ttl_us, len(keys) + 1), lambda s: s.get("until"), "reserved", "boolean")


def logins(attempts: DataFrame, most: int, window_us: int, late: str) -> DataFrame:
    """Stream form of operators.events.login_limit: attempts have user_id, sequence, at_us and
    created_at. A user's state is let go when the window has closed."""
    df = attempts.select("user_id", "sequence", "at_us", "created_at")
    return fold_stream(df, ["user_id"], "at_us", "sequence", "created_at", late, login_step(most, window_us, 2), lambda s: s["start"] + window_us if "start" in s else None, "allowed", "boolean")


class _Runs(StatefulProcessor):
    """The state of a run, and its end by silence."""

    def __init__(self, silent_us: int) -> None:
        self.silent = silent_us

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.state = handle.getValueState("run", "end_seq long, end_kind string, last_seq long, last_kind string, events long, at_us long")

    def _row(self, key: tuple, end: str | None, last: str, events: int, recovered: bool) -> Row:
        return Row(run_id=key[0], state=state_name(end, last), events=events, code="server_restarted" if recovered else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.state.get() or (None, None, None, None, 0, 0)
        end, last, events, at = (held[0], held[1]), (held[2], held[3]), held[4], held[5]
        for r in rows:
            sequence, kind, us = r[1], r[2], r[3]
            if kind in TERMINAL and (end[0] is None or sequence < end[0]):
                end = (sequence, kind)
            if last[0] is None or sequence > last[0]:
                last = (sequence, kind)
            events, at = events + 1, max(at, us)
        self.state.update((*end, *last, events, at))
        self.handle.registerTimer(max(-(-(at + self.silent) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter([self._row(key, end[1], last[1], events, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.state.get()
        # a timer of before the last event finds that the run went on
        if held is None or held[5] + self.silent > timerValues.getCurrentWatermarkInMs() * 1000:
            return iter(())
        self.state.clear()
        return iter([self._row(key, "run.failed", "run.failed", held[4], True)] if held[1] is None else [])

    def close(self) -> None:
        pass


def run_states(events: DataFrame, silent: str, late: str) -> DataFrame:
    """States of runs as rows that settle: run_id, state, events, code. A run's row is sent
    again with every batch that has events of it, and once more, as failed with the code
    server_restarted, when the watermark is `silent` past the last event of a run that has no
    terminal one. After that time the state of any run is let go. settled_states() keeps the
    row that counts. events: run_id, sequence, event_type, created_at."""
    silent_us = int(pd.Timedelta(silent).total_seconds() * 1_000_000)
    rows = events.select("run_id", "sequence", "event_type", F.unix_micros("created_at").alias("at_us"), "created_at").withWatermark("created_at", late)
    return rows.groupBy("run_id").transformWithState(_Runs(silent_us), "run_id string, state string, events long, code string", "Update", "EventTime")


def settled_states(told: DataFrame) -> DataFrame:
    """Of what run_states() has sent, the last row of each run."""
    last = F.max_by(F.struct("state", "events", "code"), F.struct("events", F.col("code").isNotNull().cast("int")))
    return told.groupBy("run_id").agg(last.alias("_l")).select("run_id", "_l.*")
