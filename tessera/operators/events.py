"""Run, stream and queue semantics in batch form; streaming/events.py has the same as
Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold

TERMINAL = ["run.completed", "run.failed", "run.cancelled"]


def replay(events: DataFrame, run: str, after: int) -> DataFrame:
    return events.where((F.col("run_id") == run) & (F.col("sequence") > after)).orderBy("sequence")


def unseen(events: DataFrame, key: str, id: str, order: list[str]) -> DataFrame:
    """Events whose id is greater than all ids that came before for the same key, in order
    of arrival: ids grow, so one that doesn't is a repetition. A null id is dropped."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(id).over(before)
    return events.withColumn("_last", last).where(F.col(id).isNotNull() & (F.col("_last").isNull() | (F.col(id) > F.col("_last")))).drop("_last")


def run_state(events: DataFrame) -> DataFrame:
    """The state that each run has reached: the first terminal event ends it, else the
    furthest of its last events counts."""
    kind = F.col("event_type")
    term = F.min(F.when(kind.isin(TERMINAL), F.struct("sequence", "event_type")))
    last = F.max_by("event_type", "sequence")
    g = events.groupBy("run_id").agg(term.alias("t"), last.alias("l"), F.count("*").alias("events"))
    return g.select("run_id", state_of(F.col("t.event_type"), F.col("l")).alias("state"), "events")


def state_of(end: Column, last: Column) -> Column:
    """The state of a run by its first terminal event (null: none) and its last event."""
    return F.when(end == "run.completed", "COMPLETED").when(end == "run.cancelled", "CANCELLED").when(end.isNotNull(), "FAILED").when(last == "route.resolved", "RETRIEVING").when(last.isin("message.delta", "message.completed"), "GENERATING").otherwise("ROUTING")


def state_name(end: str | None, last: str) -> str:
    """The state of a run by its first terminal event, if any, and its last event."""
    if end:
        return {"run.completed": "COMPLETED", "run.cancelled": "CANCELLED"}.get(end, "FAILED")
    return {"route.resolved": "RETRIEVING", "message.delta": "GENERATING", "message.completed": "GENERATING"}.get(last, "ROUTING")


def terminal_once(events: DataFrame) -> DataFrame:
    """Drops terminal events after the first of a run."""
    first = events.where(F.col("event_type").isin(TERMINAL)).groupBy("run_id").agg(F.min("sequence").alias("end"))
    return events.join(first, "run_id", "left").where(~F.col("event_type").isin(TERMINAL) | (F.col("sequence") == F.col("end"))).drop("end")


def silent_runs(events: DataFrame, now_us: Column, silent_us: int) -> DataFrame:
    """run_state() with runs that have no terminal event and had none at all for silent_us
    before now closed as failed. Columns run_id, sequence, event_type, at_us."""
    last = events.groupBy("run_id").agg(F.max("at_us").alias("_at"), F.bool_or(F.col("event_type").isin(TERMINAL)).alias("_ended"))
    dead = ~F.col("_ended") & (F.col("_at") + silent_us <= now_us)
    return run_state(events).join(last, "run_id").select("run_id", F.when(dead, "FAILED").otherwise(F.col("state")).alias("state"), "events", F.when(dead, "server_restarted").alias("code"))


def recover(runs: DataFrame) -> DataFrame:
    """A failure event for each run that never ended."""
    return runs.where(~F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")).select("run_id", F.lit("run.failed").alias("event_type"), F.lit("server_restarted").alias("code"), F.lit(True).alias("retryable"))


def coalesce_deltas(events: DataFrame, size: int = 96, tick_ms: int = 120, start_ms: str | None = None) -> DataFrame:
    """What is sent of a run's deltas (run_id, sequence, at_ms, delta): what is pending goes out
    as soon as it has `size` bytes, and with every tick; a tick comes every tick_ms from the
    run's start (column start_ms; None: its first delta). Empty deltas count for nothing.
    Between two ticks nothing is left over from before, so (run, tick) is folded as a key of
    its own: a long run is dealt over many tasks. One row per flush: run_id, tick, flush,
    first_sequence, deltas, bytes, text."""
    start = F.col(start_ms) if start_ms else F.min("at_ms").over(Window.partitionBy("run_id"))
    d = events.where(F.char_length("delta") > 0)
    d = d.withColumn("tick", F.floor((F.col("at_ms") - start) / tick_ms).cast("long")).select("run_id", "tick", "sequence", F.octet_length("delta").alias("bytes"), "delta")

    def step(state: dict, row: tuple) -> int:
        if state.get("pending", 0) >= size:
            state["flush"], state["pending"] = state["flush"] + 1, 0
        state["flush"], state["pending"] = state.get("flush", 0), state.get("pending", 0) + row[3]
        return state["flush"]

    g = fold(d, ["run_id", "tick"], ["sequence"], dict, step, "flush", "int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "delta"))), lambda x: x["delta"]), "")
    return g.groupBy("run_id", "tick", "flush").agg(F.min("sequence").alias("first_sequence"), F.count("*").alias("deltas"), F.sum("bytes").alias("bytes"), text.alias("text"))


def rebuild_answer(events: DataFrame) -> DataFrame:
    """Deltas in order, unless the last final text overrides them; an empty one doesn't."""
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("sequence", "text")))), lambda x: x["text"]), "")
    final = F.max_by(F.when(F.col("kind") == "final", F.col("text")), F.when(F.col("kind") == "final", F.col("sequence")))
    return events.groupBy("run_id").agg(F.coalesce(F.nullif(final, F.lit("")), deltas).alias("answer"))


def rate_limit(events: DataFrame, limit: int, ms: Column, minutes: int = 1) -> DataFrame:
    """The first `limit` events of a user in a fixed window pass."""
    w = Window.partitionBy("user_id", "slot").orderBy("sequence")
    return events.withColumn("slot", F.floor(ms / (60_000_000 * minutes))).withColumn("allowed", F.row_number().over(w) <= limit)


def reservation_step(ttl_us: int, at: int):  # noqa: ANN201
    """Step of a fold over a key's events: whether an event finds no live reservation. One
    lasts ttl from the event that made it. at: where its microsecond stands in a row."""
    def step(state: dict, row: tuple) -> bool:
        fresh = "until" not in state or row[at] >= state["until"]
        if fresh:
            state["until"] = int(row[at]) + ttl_us
        return fresh

    return step


def idempotent(events: DataFrame, key: list[str], ttl_us: int, us: str) -> DataFrame:
    """Events that find no live reservation of their key. A reservation lasts ttl from
    the event that made it, so the events of a key are folded in order."""
    df = events.select(*key, "sequence", us)
    return fold(df, key, ["sequence"], dict, reservation_step(ttl_us, df.columns.index(us)), "reserved", "boolean")


def login_step(most: int, window_us: int, at: int):  # noqa: ANN201
    """Step of a fold over a user's attempts: whether one is let through. A window opens with
    the first attempt and lets `most` through until it closes."""
    def step(state: dict, row: tuple) -> bool:
        if "start" not in state or row[at] - state["start"] >= window_us:
            state["start"], state["n"] = int(row[at]), 0
        state["n"] += 1
        return state["n"] <= most

    return step


def login_limit(attempts: DataFrame, most: int = 5, window_us: int = 60_000_000) -> DataFrame:
    """Attempts by user: a window opens with the first attempt and lets `most` through
    until it closes. Columns user_id, sequence, at_us."""
    return fold(attempts.select("user_id", "sequence", "at_us"), ["user_id"], ["sequence"], dict, login_step(most, window_us, 2), "allowed", "boolean")


def host_pressure(log: DataFrame, streak: int = 5, penalty: float = 4.0, calm: int = 10) -> DataFrame:
    """Delay factor of a host after each request: `penalty` once `streak` failures under
    pressure (status 429, 503 or any 5xx) came without a success between, back to 1 after
    `calm` successes in a row. Any other failure (404, no answer) only ends the row of
    successes. Columns host, sequence, ok, status."""
    def step(state: dict, row: tuple) -> float:
        _, _, ok, status = row[:4]
        if ok:
            state["bad"], state["good"] = 0, state.get("good", 0) + 1
            if state["good"] >= calm:
                state["factor"] = 1.0
        else:
            state["good"] = 0
            if status is not None and (status == 429 or 500 <= status < 600):
                state["bad"] = state.get("bad", 0) + 1
                if state["bad"] >= streak:
                    state["factor"] = penalty
        return state.get("factor", 1.0)

    return fold(log.select("host", "sequence", "ok", "status"), ["host"], ["sequence"], dict, step, "factor", "double")


def model_cursor(calls: DataFrame, models: int, advance: list[str]) -> DataFrame:
    """Which model of a pool each call uses: an error of a listed code (case and white space
    at its ends don't matter) moves the pool on to the next model, and it stays there. After
    the last one the pool is exhausted: model is null and failure says so. Columns pool,
    sequence, error. Only the first `models` such errors of a pool count; they are found by a
    top-k before the shuffle, so a pool that makes most calls costs no task more."""
    moving = calls.where(F.lower(F.btrim("error")).isin([a.lower() for a in advance])).select("pool", "sequence")
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("sequence"))
    cuts = moving.withColumn("_n", rank).where(F.col("_n") <= models).groupBy("pool").agg(F.array_sort(F.collect_list("sequence")).alias("_cuts"))
    passed = F.size(F.filter(F.coalesce("_cuts", F.array().cast(f"array<{calls.schema['sequence'].dataType.simpleString()}>")), lambda c: c < F.col("sequence")))
    found = calls.join(cuts, "pool", "left").withColumn("_at", passed)
    over = F.col("_at") >= models
    return found.withColumn("model", F.when(~over, F.col("_at"))).withColumn("failure", F.when(over, "model_pool_exhausted")).drop("_at", "_cuts")


def crawl_order(found: DataFrame, order: list[Column], pages: int = 500, batch: int = 8) -> DataFrame:
    """The first pages of a crawl in its order, in batches. The number of pages is the crawl's
    budget: a top-k, so only these rows are numbered."""
    first = found.orderBy(*order).limit(pages)
    return first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / batch))


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def sse_frame(id_: Column, event: Column, data: Column) -> Column:
    return F.format_string("id: %d\nevent: %s\ndata: %s\n\n", id_, event, data)


def sse_parse(frame: Column) -> Column:
    """Struct of id, event, data of one server-sent block: comments are skipped, data
    lines joined; null unless it has data that is JSON."""
    lines = F.filter(F.split(frame, "\r?\n"), lambda l: ~l.startswith(":") & (l != ""))
    field = lambda name: F.transform(F.filter(lines, lambda l: l.rlike(f"^{name}:")), lambda l: F.regexp_replace(l, f"^{name}: ?", ""))
    data = F.array_join(field("data"), "\n")
    ok = (data != "") & F.try_parse_json(data).isNotNull()
    return F.when(ok, F.struct(F.try_element_at(field("id"), F.lit(-1)).alias("id"), F.coalesce(F.try_element_at(field("event"), F.lit(-1)), F.lit("message")).alias("event"), data.alias("data")))


def enqueue(queue: DataFrame, found: DataFrame, key: list[str], ord_: str) -> DataFrame:
    """Found URLs that the queue doesn't hold, the first of each key."""
    rest = [c for c in found.columns if c not in key]
    first = found.groupBy(*key).agg(F.min_by(F.struct(*rest), ord_).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return first.join(queue.select(*key), key, "left_anti")


def claim(queue: DataFrame, now: Column, lease_us: int, limit: int) -> DataFrame:
    """The rows that a worker takes next: expired claims are open again; due rows by
    priority, depth, time of creation and id. Needs one writer at a time."""
    open_ = F.col("status").isin("DISCOVERED", "PENDING") | ((F.col("status") == "CLAIMED") & (F.col("claimed_us") < now - lease_us))
    due = F.col("next_us").isNull() | (F.col("next_us") <= now)
    return queue.where(open_ & due).orderBy("priority", "depth", "created_us", "id").limit(limit)


def transition(queue: DataFrame, outcome: str, now: Column, tries: int = 3) -> DataFrame:
    """Status, tries and next time after an outcome: fetched, parsed (due again in seven
    days), failed (given up after `tries`, else due after 2^min(tries, 5) minutes) or ignored."""
    o, n = F.col(outcome), F.col("retry_count")
    status = F.when(o == "fetched", "FETCHED").when(o == "parsed", "PARSED").when(o == "ignored", "IGNORED").when(n + 1 >= tries, "FAILED").otherwise("PENDING")
    wait = F.when(o == "parsed", F.lit(7 * 86_400_000_000)).when(o == "failed", (F.pow(F.lit(2.0), F.least(n, F.lit(5))) * 60_000_000).cast("long"))
    return queue.withColumn("new_status", status).withColumn("new_retry", n + (o == "failed").cast("int")).withColumn("next_us", now + wait)


def live_tokens(tokens: DataFrame, users: DataFrame, now: Column, kind: str) -> DataFrame:
    """Users of tokens of a kind that are neither revoked nor expired; active users only."""
    ok = (F.col("kind") == kind) & F.col("revoked_us").isNull() & (F.col("expires_us") > now)
    return tokens.where(ok).join(users.where("status = 'active'"), "user_id")


def rotated(tokens: DataFrame, users: DataFrame, used: DataFrame, now: Column, access_us: int, refresh_us: int) -> DataFrame:
    """The token table after refresh tokens were used: a valid one is revoked, and an access
    and a refresh token take its place; others change nothing."""
    valid = live_tokens(tokens, users, now, "refresh").join(used, "token_hash", "left_semi").select("token_hash", "user_id").withColumn("hit", F.lit(True))
    old = tokens.join(valid.select("token_hash", "hit"), "token_hash", "left").withColumn("revoked_us", F.when(F.col("hit"), now).otherwise(F.col("revoked_us"))).drop("hit")
    fresh = valid.select(F.explode(F.array(F.lit("access"), F.lit("refresh"))).alias("kind"), "token_hash", "user_id")
    fresh = fresh.select(F.sha2(F.concat_ws("\0", "token_hash", "kind"), 256).alias("token_hash"), "user_id", "kind", F.lit(None).cast("long").alias("revoked_us"), (now + F.when(F.col("kind") == "access", access_us).otherwise(refresh_us)).alias("expires_us"))
    return old.select(*fresh.columns).union(fresh)


def attempts(calls: DataFrame, limit: int = 2000) -> DataFrame:
    """Audit rows of attempts: numbered per URL, error text cut."""
    w = Window.partitionBy("url_id").orderBy("started_us", "sequence")
    return calls.withColumn("attempt", F.row_number().over(w)).withColumn("error_message", F.substring(F.coalesce("error_message", F.lit("")), 1, limit))
