"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import state_of
from ..operators.metrics import micros
from ..sources.tables import checkpoint_folder, kept_in_scope
from .state import rocksdb

TERMINAL = ["run.completed", "run.failed", "run.cancelled"]


def source(spark: SparkSession, path: str, table: str, files_per_trigger: int = 16) -> DataFrame:
    """A table's files as a stream, a bounded number in each micro-batch."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(_folder(path, table))


def _folder(path: str, table: str) -> str:
    """A stream reads a folder; a table in one file is picked by a glob."""
    return f"{path}/{table}.parquet*"


def run_events(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "route.resolved").when(F.col("event_type") == "click", "message.delta").when(F.col("event_type") == "signup", "message.completed").when(F.col("event_type") == "purchase", "run.completed").otherwise("run.failed")
    run = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string"))
    return events.select(F.col("event_id").alias("sequence"), run.alias("run_id"), F.col("ts").cast("timestamp").alias("created_at"), kind.alias("event_type"))


def tumbling(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(micros(F.col("w.start").cast("timestamp_ntz")).alias("start_us"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Repeated events within the watermark are dropped; state older than it is let go."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(keys)


def terminal_once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The terminal event of each run, as rows that settle: a run's row is sent when its first
    terminal event comes, and again when one with a smaller sequence comes later, in whatever
    order files and batches arrive; the smallest counts (settled_terminals). The state of a run
    is let go once the watermark is `late` past its last event, so it doesn't grow for ever."""
    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        least, at = state.get if state.exists else (None, 0)
        for rows in parts:
            at = max(at, int(rows["at_ms"].max()))
            new = int(rows["sequence"].min())
            if least is None or new < least:
                least = new
                yield pd.DataFrame({"run_id": [key[0]], "sequence": [least]})
        state.update((least, at))
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + 1)

    only = events.where(F.col("event_type").isin(TERMINAL)).withWatermark("created_at", late)
    rows = only.select("run_id", "sequence", F.unix_millis("created_at").alias("at_ms"), "created_at")
    return rows.groupBy("run_id").applyInPandasWithState(first, "run_id string, sequence long", "sequence long, at_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def first_terminals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The same as rows of a streaming aggregate (mode update), for many runs: a window of
    `late` of a run has a row of its own, sent again when its smallest terminal sequence
    changes; settled_terminals() takes the smallest of all. State is let go with the window, once
    terminal events have moved the watermark past it."""
    only = events.where(F.col("event_type").isin(TERMINAL)).withWatermark("created_at", late)
    return only.groupBy("run_id", F.window("created_at", late)).agg(F.min("sequence").alias("sequence")).select("run_id", "sequence")


def run_parts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """What is known of each run in each window of `late`, as rows of a streaming aggregate
    (mode update), sent again with every batch that has events of it: the first terminal event
    (sequence and kind, or null), the last event, how many there were, and the time of the
    latest. settled_runs() puts a run's windows together; state is let go with the window.
    events: run_id, sequence, event_type, created_at."""
    one = F.struct("sequence", "event_type")
    g = events.withWatermark("created_at", late).groupBy("run_id", F.window("created_at", late).alias("w")).agg(
        F.min(F.when(F.col("event_type").isin(TERMINAL), one)).alias("end"), F.max(one).alias("last"), F.count("*").alias("events"), F.max(F.unix_micros("created_at")).alias("at_us"),
    )
    return g.select("run_id", F.unix_micros("w.start").alias("start_us"), "end", "last", "events", "at_us")


def settled_runs(told: DataFrame, silent: str, late: str = "1 day") -> DataFrame:
    """run_id, state, events, code of what run_parts() has sent. A run without a terminal event
    has failed with the code server_restarted once the watermark, which is `late` behind the
    latest event of all, is `silent` past its last one."""
    us = lambda span: int(pd.Timedelta(span).total_seconds() * 1_000_000)
    now = F.max_by(F.struct("end", "last", "events", "at_us"), "events")
    parts = told.groupBy("run_id", "start_us").agg(now.alias("p")).select("run_id", "p.*")
    runs = parts.groupBy("run_id").agg(F.min("end").alias("end"), F.max("last").alias("last"), F.sum("events").alias("events"), F.max("at_us").alias("at_us"))
    mark = told.agg((F.max("at_us") - us(late)).alias("mark_us"))
    dead = F.col("end").isNull() & (F.col("at_us") + us(silent) <= F.col("mark_us"))
    state = F.when(dead, "FAILED").otherwise(state_of(F.col("end.event_type"), F.col("last.event_type")))
    return runs.join(F.broadcast(mark)).select("run_id", state.alias("state"), "events", F.when(dead, "server_restarted").alias("code"))


def settled_terminals(told: DataFrame) -> DataFrame:
    """What terminal_once() has sent, with the row that counts of each run."""
    return told.groupBy("run_id").agg(F.min("sequence").alias("sequence"))


def rate_limited(events: DataFrame, limit: int, late: str = "2 minutes") -> DataFrame:
    """Users over the limit in each minute, as windows close."""
    e = events.withWatermark("created_at", late)
    return e.groupBy("user_id", F.window("created_at", "1 minute")).count().withColumn("over", F.col("count") > limit)


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs the stream over what its source holds now and returns the result. The rows go to
    Parquet in the shared folder (append) or to the table that foreachBatch last wrote."""
    spark = stream.sparkSession
    base = kept_in_scope(f"{checkpoint_folder(spark)}/streams/{name}-{uuid.uuid4().hex}")
    out = f"{base}/out"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is retried after a failure overwrites its own folder
        target = out if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    with rocksdb(spark):
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
