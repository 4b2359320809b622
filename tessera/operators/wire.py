"""Events on their way: numbers for appended ones, bounded fan-out, streams of model tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settle
from .events import unseen


def appended(log: DataFrame, batch: DataFrame, order: list[str], sequence: str = "sequence") -> DataFrame:
    """The batch with the sequence numbers that follow those of the log, without gaps, in the
    given order (which must tell all rows apart). Rows are dealt to ranges, each range is
    numbered by itself behind the sizes of the ranges before it; only those sizes, one row
    a range, meet in one task. One writer at a time."""
    placed = settle(batch.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    top = log.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("_top"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = placed.withColumn("_place", place).join(starts, "_range").crossJoin(top)  # one row of totals
    return rows.withColumn(sequence, (F.col("_top") + F.col("_start") + F.col("_place")).cast("long")).drop("_range", "_start", "_place", "_top")


def fan_out(log: DataFrame, buffer: int = 32) -> DataFrame:
    """Which published events reach a subscriber whose buffer holds `buffer` of them. Columns
    subscriber, ord, published (false: the subscriber takes one out; from an empty buffer
    it takes nothing). An event that finds the buffer full disconnects the subscriber: it and
    all later ones aren't delivered, and the client reads them again from the log by offset
    (`events.replay`). Fill levels follow from running sums: the sum of steps less its
    lowest value below zero so far."""
    w = Window.partitionBy("subscriber").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("published"), 1).otherwise(-1)
    level = log.withColumn("_sum", F.sum(step).over(w)).withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    lost = F.max(F.col("published") & (F.col("_depth") > buffer)).over(w)
    return level.withColumn("delivered", F.col("published") & ~lost).drop("_sum", "_depth")


CHUNK = "model string, choices array<struct<delta: struct<content: string>>>, usage struct<prompt_tokens: long, completion_tokens: long>"


def _chunks(lines: DataFrame) -> DataFrame:
    """Data lines of each stream up to its end: stream, ord, stop ('' while it goes on), chunk."""
    framed = r"^\s*data:\s*([\s\S]*?)\s*$"
    data = lines.where(F.col("line").rlike(framed)).select("stream", "ord", F.regexp_extract("line", framed, 1).alias("data"))
    stop = F.when(F.col("data") == "[DONE]", "done").when(F.try_parse_json("data").isNull() | ~F.col("data").startswith("{"), "invalid_stream").otherwise("")
    before = Window.partitionBy("stream").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    live = data.withColumn("stop", stop).withColumn("_past", F.coalesce(F.max(F.col("stop") != "").over(before), F.lit(False)))
    return live.where(~F.col("_past")).select("stream", "ord", "stop", F.from_json("data", CHUNK).alias("chunk"))


def stream_deltas(lines: DataFrame) -> DataFrame:
    """Text pieces of streams of chat completions as they were landed (stream, ord, line):
    stream, ord, choice, delta. Lines after the end mark or after a broken chunk don't count;
    empty pieces are skipped."""
    rows = _chunks(lines).where("stop = ''").select("stream", "ord", F.posexplode("chunk.choices").alias("choice", "_c"))
    return rows.select("stream", "ord", "choice", F.col("_c.delta.content").alias("delta")).where("delta <> ''")


def stream_results(lines: DataFrame, model: str = "") -> DataFrame:
    """One row for each stream with a line: content, model, input_tokens, output_tokens and
    error. The last usage that isn't all zero counts; a stream without its end mark
    ('stream_incomplete') or with a broken chunk ('invalid_stream') has no result but its error."""
    c = F.col("chunk")
    text = F.array_join(F.transform(F.filter(c["choices"], lambda x: x["delta"]["content"].isNotNull()), lambda x: x["delta"]["content"]), "")
    used = (c["usage"]["prompt_tokens"] > 0) | (c["usage"]["completion_tokens"] > 0)
    last = lambda value, ok: F.max_by(F.when(ok, value), F.when(ok, F.col("ord")))
    usage = lambda field: F.coalesce(c["usage"][field], F.lit(0))
    parts = F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", F.struct("ord", text.alias("t"))))
    g = _chunks(lines).groupBy("stream").agg(
        F.array_join(F.transform(F.array_sort(parts), lambda x: x["t"]), "").alias("content"),
        last(c["model"], c["model"] != "").alias("model"),
        last(usage("prompt_tokens"), used).alias("input_tokens"),
        last(usage("completion_tokens"), used).alias("output_tokens"),
        F.max("stop").alias("stop"),
    )
    every = lines.select("stream").distinct().join(g, "stream", "left")
    error = F.when(F.col("stop") == "done", "").when(F.col("stop") == "invalid_stream", "invalid_stream").otherwise("stream_incomplete")
    whole = lambda value: F.when(error == "", value)
    zero = lambda name: F.coalesce(name, F.lit(0))
    return every.select("stream", whole(F.col("content")).alias("content"), whole(F.coalesce("model", F.lit(model))).alias("model"), whole(zero("input_tokens")).alias("input_tokens"), whole(zero("output_tokens")).alias("output_tokens"), error.alias("error"))


def product_event(kind: Column, known: dict[str, str]) -> Column:
    """What a wire event means to the client; null for kinds that it passes over."""
    return F.coalesce(*[F.when(kind == wire, name) for wire, name in known.items()])


def client_events(received: DataFrame, key: str, known: dict[str, str], terminal: list[str], tries: int = 3) -> DataFrame:
    """What a client shows of a stream (key, attempt from 0, ord, id, event_type) over its
    reconnects: of the first `tries` attempts the events whose id is above all ids before,
    up to the first terminal one, by their meaning; then, without a terminal event, one
    run_failed. Columns key, n (order), id, kind."""
    heard = received.where(F.col("attempt") < tries)
    new = unseen(heard, key, "id", ["attempt", "ord"])
    end = new.where(F.col("event_type").isin(terminal)).groupBy(key).agg(F.min("id").alias("_end"))
    shown = new.join(end, key, "left").where(F.col("_end").isNull() | (F.col("id") <= F.col("_end"))).select(key, "id", product_event(F.col("event_type"), known).alias("kind")).where("kind is not null")
    lost = received.select(key).distinct().join(end, key, "left_anti").select(key, F.lit(None).cast(received.schema["id"].dataType).alias("id"), F.lit("run_failed").alias("kind"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("id").asc_nulls_last()))
    return shown.union(lost).select(key, n.alias("n"), "id", "kind")
