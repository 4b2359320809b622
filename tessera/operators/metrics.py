"""Operational metrics over users, messages, runs and the event log.

Every function takes DataFrames and parameters (window, zone) and declares one plan;
aggregates are partial before each shuffle, so a hot run, user or day is no burden."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settle


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)


def zone_day(c: Column | str, zone: str) -> Column:
    """Calendar day in a zone of a UTC timestamp."""
    return F.from_utc_timestamp(F.col(c) if isinstance(c, str) else c, zone).cast("date")


def between(c: str, start: str, end: str) -> Column:
    return (F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))


def user_retention(users: DataFrame, activity: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """Registered, new and active users; users eligible for (by elapsed time before the
    end) and retained on (by calendar day in the zone) day 1 and day 7."""
    stop = F.lit(end).cast("timestamp_ntz")
    cohort = users.where(between("created_at", start, end)).select("user_id", zone_day("created_at", zone).alias("day"), (F.col("created_at") < stop - F.expr("interval 1 day")).alias("e1"), (F.col("created_at") < stop - F.expr("interval 7 days")).alias("e7"))
    seen = activity.select("user_id", zone_day("created_at", zone).alias("seen")).distinct()
    # the days that matter are told apart before the join, so a user gives two flags at most
    hits = cohort.select("user_id", "day").join(seen, "user_id").groupBy("user_id").agg(F.max(F.col("seen") == F.date_add("day", 1)).alias("r1"), F.max(F.col("seen") == F.date_add("day", 7)).alias("r7"))
    j = cohort.join(hits, "user_id", "left")
    r = lambda e, k: F.count_if(F.col(e) & F.coalesce(F.col(k), F.lit(False)))
    main = j.agg(F.count("*").alias("new_registered"), F.count_if("e1").alias("d1_eligible"), r("e1", "r1").alias("d1_retained"), F.count_if("e7").alias("d7_eligible"), r("e7", "r7").alias("d7_retained"))
    total = users.where(F.col("created_at") < stop).agg(F.count("*").alias("total_registered"))
    active = activity.where(between("created_at", start, end)).agg(F.countDistinct("user_id").alias("active_users"))
    return total.crossJoin(active).crossJoin(main)  # three rows of totals


def engagement(messages: DataFrame, start: str, end: str) -> DataFrame:
    return messages.where((F.col("role") == "user") & between("created_at", start, end)).agg(F.count("*").alias("questions"), F.countDistinct("session_id").alias("active_sessions"))


def run_facts(runs: DataFrame, events: DataFrame, route_path: str = "$.k", message_path: str = "$.k") -> DataFrame:
    """One row per run: status, error, route, answer message, latency and time to the
    first delta in milliseconds. Events are reduced to one row per run before the join."""
    kind = F.col("event_type")
    facts = events.groupBy("run_id").agg(
        F.max(F.when(kind == "route.resolved", F.get_json_object("payload", route_path))).alias("route"),
        F.min(F.when(kind == "message.delta", F.col("created_at"))).alias("first_delta"),
        F.min(F.when(kind.isin("run.completed", "run.failed"), F.col("created_at"))).alias("terminal"),
        F.max(F.when(kind == "message.completed", F.get_json_object("payload", message_path))).alias("message"),
    )
    ms = lambda c: (micros(c) - micros("created_at")) / F.lit(1000.0)
    return runs.join(facts, "run_id", "left").select("run_id", "status", "error_code", F.coalesce("route", F.lit("")).alias("route"), F.coalesce("message", F.lit("")).alias("assistant_message_id"), ms("terminal").alias("latency_ms"), ms("first_delta").alias("ttft_ms"))


#: Rows among which an order statistic is picked at once, and parts of a pass before that.
FEW, PARTS = 1 << 16, 1024


def exact_percentiles(values: DataFrame, column: str, shares: list[float], settled: bool = False) -> list[float | None]:
    """Exact continuous percentiles (between two values in proportion, as percentile() gives
    them) without holding the values in one task: each pass counts the values in PARTS parts
    of the ranges that still hold a wanted rank, so a range shrinks to one part of it, until
    it holds one value or FEW rows. Nulls and NaN are left out; without values all are None.
    Only counts and FEW rows come to the driver. settled: values may be read several times as
    they are."""
    v = F.col("_v")
    rows = values.select(F.col(column).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    rows = rows if settled else settle(rows)
    n, low, high = rows.agg(F.count("*"), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(shares)
    places = {p: p * (n - 1) for p in shares}
    open_ = {r: (low, high, 0, n) for p in places.values() for r in (math.floor(p), math.ceil(p))}  # range, rows below and in it
    found: dict[int, float] = {}
    while open_:
        for r, (a, b, _, _) in list(open_.items()):
            if a == b:
                found[r] = a
                del open_[r]
        ranges = sorted({x for x in open_.values()})
        small = [x for x in ranges if x[3] <= FEW]
        for a, b, below, _ in small:
            held = sorted(r[0] for r in rows.where(v.between(a, b)).collect())
            for r in [r for r, x in open_.items() if x[0] == a and x[1] == b]:
                found[r] = held[r - below]
                del open_[r]
        wide = [x for x in ranges if x[3] > FEW]
        if not wide:
            continue
        of = F.coalesce(*[F.when(v.between(a, b), i) for i, (a, b, _, _) in enumerate(wide)])
        part = F.coalesce(*[F.when(v.between(a, b), F.least(F.floor((v / 2 - a / 2) / (b / 2 - a / 2) * PARTS), F.lit(PARTS - 1))) for a, b, _, _ in wide])
        counts = rows.select(of.alias("of"), part.alias("part"), v).where("of is not null").groupBy("of", "part").agg(F.count("*").alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).orderBy("of", "part").collect()
        for i, (a, b, below, _) in enumerate(wide):
            for c in (c for c in counts if c.of == i):
                for r in [r for r, x in open_.items() if x[:2] == (a, b) and below <= r < below + c.n]:
                    open_[r] = (c.a, c.b, below, c.n)
                below += c.n
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places.values()]


def run_quality(facts: DataFrame, cited: DataFrame | None = None, controlled: str = "controlled") -> DataFrame:
    """Counts by status, answers without sources, latency and first-delta statistics.
    cited: message_id of messages with citations."""
    if cited is not None:
        facts = facts.join(cited.select(F.col("message_id").alias("assistant_message_id"), F.lit(True).alias("cited")).distinct(), "assistant_message_id", "left")
    else:
        facts = facts.withColumn("cited", F.lit(None).cast("boolean"))
    done = F.col("status") == "COMPLETED"
    none = done & (F.col("route") != controlled) & (F.col("assistant_message_id") != "") & F.col("cited").isNull()
    facts = settle(facts.select("status", "route", "assistant_message_id", "cited", "latency_ms", "ttft_ms"))
    exact = dict(zip((("latency_ms", 0.5), ("latency_ms", 0.95)), exact_percentiles(facts, "latency_ms", [0.5, 0.95], settled=True), strict=True))
    exact["ttft_ms", 0.95] = exact_percentiles(facts, "ttft_ms", [0.95], settled=True)[0]
    pct = lambda c, p: F.round(F.lit(exact[c, p] or 0.0), 6)
    avg = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return facts.agg(F.count("*").alias("runs"), F.count_if(done).alias("completed_runs"), F.count_if(F.col("status") == "FAILED").alias("failed_runs"), F.count_if(F.col("status") == "CANCELLED").alias("cancelled_runs"), F.count_if(none).alias("no_source_answers"), avg("latency_ms").alias("avg_latency_ms"), pct("latency_ms", 0.5).alias("p50_latency_ms"), pct("latency_ms", 0.95).alias("p95_latency_ms"), avg("ttft_ms").alias("avg_ttft_ms"), pct("ttft_ms", 0.95).alias("p95_ttft_ms"))


def cost_metrics(usage: DataFrame, runs: DataFrame, sessions: DataFrame, school: str) -> DataFrame:
    """Sums over usage of the runs whose session belongs to the school."""
    j = usage.join(runs, "run_id").join(sessions.where(F.col("school_id") == school), "session_id")
    return j.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0)), 2).alias("cost"), F.count("*").alias("lines"))


def breakdown(df: DataFrame, name: str, blank: str | None = None, top: int = 20) -> DataFrame:
    """The most frequent values; blanks are renamed, or left out if blank is None."""
    c = F.col(name)
    rows = df.where(c != "") if blank is None else df
    return rows.select((c if blank is None else F.when(c == "", blank).otherwise(c)).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def top_questions(messages: DataFrame, top: int = 10, width: int = 200) -> DataFrame:
    """The most frequent questions after white space is collapsed."""
    q = F.substring(F.regexp_replace(F.btrim("content"), r"[ \t\n\x0B\f\r]+", " "), 1, width)
    return messages.where(F.col("role") == "user").groupBy(q.alias("question")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(top)


def daily_series(users: DataFrame, messages: DataFrame, runs: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """One row per calendar day of the zone in the half-open window, with zeros on days
    without events."""
    spark = users.sparkSession
    first = F.from_utc_timestamp(F.lit(start), zone).cast("date")
    last = F.from_utc_timestamp(F.lit(end).cast("timestamp") - F.expr("interval 1 microsecond"), zone).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    per = lambda df, *a: df.where(between("created_at", start, end)).groupBy(zone_day("created_at", zone).alias("day")).agg(*a)
    u = per(users, F.count("*").alias("new_users"))
    m = per(messages.where(F.col("role") == "user"), F.countDistinct("user_id").alias("active_users"), F.count("*").alias("questions"))
    r = per(runs, F.count("*").alias("runs"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    j = days.join(u, "day", "left").join(m, "day", "left").join(r, "day", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("new_users", "active_users", "questions", "runs", "completed", "failed")]
    return j.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *zero)


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def call_cost(tokens: Column, price_per_million: float) -> Column:
    """Micro-currency of one call, halves rounded away from zero."""
    return F.round(tokens * F.lit(price_per_million)).cast("long")


def chart_scale(values: DataFrame, c: str) -> DataFrame:
    """The axis end: the largest value (1 at least), rounded up at its first digit."""
    top = F.greatest(F.lit(1.0), F.max(F.col(c).cast("double")))
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.col("m"))))
    return values.agg(top.alias("m")).select((F.ceil(F.col("m") / step) * step).alias("scale"))


def series_faults(df: DataFrame, key: str, value: str, part: Column) -> DataFrame:
    """For each part (a series): rows whose key doesn't exceed the one before, or whose
    value is null, negative or not finite."""
    w = Window.partitionBy("series").orderBy(key, "value")
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)
    rows = df.select(part.alias("series"), F.col(key), F.col(value).cast("double").alias("value")).withColumn("before", F.lag(key).over(w))
    return rows.groupBy("series").agg(F.count_if(F.col(key) <= F.col("before")).alias("unordered"), F.count_if(bad).alias("invalid"), F.count("*").alias("points"))


def sections(df: DataFrame, label: Column, ord_: str, id_: str) -> DataFrame:
    """Items by label, in the order of the first item of each."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(ord_, id_))), lambda x: x[id_].cast("string"))
    return df.groupBy(label.alias("label")).agg(F.min(ord_).alias("first_ord"), F.array_join(items, ",").alias("items"))


def gate(events: DataFrame, key: str, ord_: str, outcome: str) -> DataFrame:
    """Checks by their last outcome; a check passes only if it ended in pass and was
    never skipped. A check that never reported isn't a pass."""
    per = events.groupBy(key).agg(F.max_by(outcome, ord_).alias("last"), F.max(F.col(outcome) == "skip").alias("skipped"))
    status = F.when(F.col("skipped"), "skipped").when(F.col("last") == "pass", "passed").when(F.col("last") == "fail", "failed").otherwise("missing")
    return per.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
