"""Queries over the event log as a stream of runs, queues and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import wire as W
from ..operators.metrics import micros
from ..streaming import events as S
from ..streaming import state as ST
from .registry import query

TERM = "('run.completed', 'run.failed', 'run.cancelled')"


@query("event_replay", "SELECT sequence, event_type, payload FROM run_events WHERE run_id = '7-2024-01-03' AND sequence > 700")
def event_replay(t):
    return E.replay(t.run_events(), "7-2024-01-03", 700).select("sequence", "event_type", "payload")


@query("event_dedup", "WITH f AS (SELECT run_id, max(sequence) AS m FROM run_events WHERE sequence % 5 <> 4 GROUP BY 1) SELECT e.run_id, e.sequence, e.event_type FROM run_events e LEFT JOIN f USING (run_id) WHERE e.sequence % 5 <> 4 OR f.m IS NULL OR e.sequence > f.m")
def event_dedup(t):
    """A stream that lost every fifth event, then a second delivery of the whole run."""
    e = t.run_events().select("run_id", "sequence", "event_type")
    first = e.where(F.col("sequence") % 5 != 4).withColumn("attempt", F.lit(0))
    return E.unseen(first.unionByName(e.withColumn("attempt", F.lit(1))), "run_id", "sequence", ["attempt", "sequence"]).drop("attempt")


@query("run_state", f"WITH t AS (SELECT run_id, min(sequence) AS s FROM run_events WHERE event_type IN {TERM} GROUP BY 1), g AS (SELECT e.run_id, max(CASE WHEN e.sequence = t.s THEN e.event_type END) AS te, arg_max(e.event_type, e.sequence) AS l, count(*) AS events FROM run_events e LEFT JOIN t USING (run_id) GROUP BY 1) SELECT run_id, events, CASE WHEN te = 'run.completed' THEN 'COMPLETED' WHEN te = 'run.cancelled' THEN 'CANCELLED' WHEN te IS NOT NULL THEN 'FAILED' WHEN l = 'route.resolved' THEN 'RETRIEVING' WHEN l IN ('message.delta', 'message.completed') THEN 'GENERATING' ELSE 'ROUTING' END AS state FROM g")
def run_state(t):
    return E.run_state(t.run_events())


@query("terminal_once", f"SELECT run_id, sequence, event_type FROM (SELECT *, row_number() OVER (PARTITION BY run_id, event_type IN {TERM} ORDER BY sequence) AS n FROM run_events) WHERE event_type NOT IN {TERM} OR n = 1")
def terminal_once(t):
    return E.terminal_once(t.run_events()).select("run_id", "sequence", "event_type")


@query("run_recover", "SELECT run_id, 'run.failed' AS event_type, 'server_restarted' AS code, true AS retryable FROM agent_runs WHERE status NOT IN ('COMPLETED', 'FAILED', 'CANCELLED')")
def run_recover(t):
    return E.recover(t.agent_runs())


@query("delta_coalesce", """WITH RECURSIVE d AS (SELECT run_id, sequence, payload AS delta, strlen(payload) AS bytes, epoch_us(created_at) // 1000 AS at_ms FROM run_events WHERE event_type IN ('message.delta', 'route.resolved') AND payload <> ''),
k AS (SELECT *, (at_ms - min(at_ms) OVER (PARTITION BY run_id)) // 14400000 AS tick FROM d), e AS (SELECT *, row_number() OVER (PARTITION BY run_id, tick ORDER BY sequence) AS n FROM k),
f AS (SELECT run_id, tick, sequence, delta, bytes, n, 0 AS flush, bytes AS pending FROM e WHERE n = 1
UNION ALL SELECT e.run_id, e.tick, e.sequence, e.delta, e.bytes, e.n, CASE WHEN f.pending >= 24 THEN f.flush + 1 ELSE f.flush END, CASE WHEN f.pending >= 24 THEN e.bytes ELSE f.pending + e.bytes END FROM f JOIN e ON e.run_id = f.run_id AND e.tick = f.tick AND e.n = f.n + 1)
SELECT run_id, tick, flush, min(sequence) AS first_sequence, count(*) AS deltas, sum(bytes)::BIGINT AS bytes, string_agg(delta, '' ORDER BY sequence) AS text FROM f GROUP BY run_id, tick, flush""")
def delta_coalesce(t):
    e = t.run_events().where(F.col("event_type").isin("message.delta", "route.resolved"))
    d = e.select("run_id", "sequence", F.col("payload").alias("delta"), F.floor(micros("created_at") / 1000).alias("at_ms"))
    return E.coalesce_deltas(d, 24, 14_400_000)


@query("answer_rebuild", "WITH k AS (SELECT run_id, sequence, payload, CASE event_type WHEN 'message.delta' THEN 'delta' WHEN 'message.completed' THEN 'final' END AS kind FROM run_events) SELECT run_id, coalesce(nullif(arg_max(payload, sequence) FILTER (WHERE kind = 'final'), ''), string_agg(payload, '' ORDER BY sequence) FILTER (WHERE kind = 'delta'), '') AS answer FROM k GROUP BY 1")
def answer_rebuild(t):
    kind = F.when(F.col("event_type") == "message.delta", "delta").when(F.col("event_type") == "message.completed", "final")
    return E.rebuild_answer(t.run_events().select("run_id", "sequence", kind.alias("kind"), F.col("payload").alias("text")))


@query("rate_limit", "SELECT sequence, row_number() OVER (PARTITION BY user_id, epoch_us(created_at) // 3600000000 ORDER BY sequence) <= 1 AS allowed FROM run_events")
def rate_limit(t):
    return E.rate_limit(t.run_events(), 1, micros("created_at"), minutes=60).select("sequence", "allowed")


@query("idempotency", """WITH RECURSIVE e AS (SELECT user_id, event_type, sequence, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sequence) AS n FROM run_events),
f AS (SELECT user_id, event_type, sequence, n, us + 36000000000 AS until, true AS reserved FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_type, e.sequence, e.n, CASE WHEN e.us >= f.until THEN e.us + 36000000000 ELSE f.until END, e.us >= f.until FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
SELECT user_id, event_type, sequence, reserved FROM f""")
def idempotency(t):
    e = t.run_events().select("user_id", "event_type", "sequence", micros("created_at").alias("us"))
    return E.idempotent(e, ["user_id", "event_type"], 36_000_000_000, "us").select("user_id", "event_type", "sequence", "reserved")


@query("login_limit", """WITH RECURSIVE e AS (SELECT user_id, sequence, epoch_us(created_at) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY sequence) AS n FROM run_events),
f AS (SELECT user_id, sequence, at_us, n, at_us AS st, 1 AS c FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.sequence, e.at_us, e.n, CASE WHEN e.at_us - f.st >= 86400000000 THEN e.at_us ELSE f.st END, CASE WHEN e.at_us - f.st >= 86400000000 THEN 1 ELSE f.c + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, sequence, at_us, c <= 3 AS allowed FROM f""")
def login_limit(t):
    return E.login_limit(t.run_events().select("user_id", "sequence", micros("created_at").alias("at_us")), 3, 86_400_000_000)


@query("host_pressure", """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS host, sequence, event_type NOT IN ('run.failed', 'run.completed') AS ok, CASE event_type WHEN 'run.failed' THEN 503 WHEN 'run.completed' THEN 404 ELSE 200 END AS status FROM run_events),
e AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY sequence) AS n FROM o),
f AS (SELECT host, sequence, ok, status, n, CASE WHEN NOT ok AND status >= 500 THEN 1 ELSE 0 END AS bad, CASE WHEN ok THEN 1 ELSE 0 END AS good, CAST(1.0 AS DOUBLE) AS factor FROM e WHERE n = 1 UNION ALL
SELECT e.host, e.sequence, e.ok, e.status, e.n, CASE WHEN e.ok THEN 0 WHEN e.status >= 500 THEN f.bad + 1 ELSE f.bad END, CASE WHEN e.ok THEN f.good + 1 ELSE 0 END, CASE WHEN NOT e.ok AND e.status >= 500 AND f.bad + 1 >= 2 THEN 4.0 WHEN e.ok AND f.good + 1 >= 3 THEN 1.0 ELSE f.factor END FROM f JOIN e ON e.host = f.host AND e.n = f.n + 1)
SELECT host, sequence, ok, status, factor FROM f""")
def host_pressure(t):
    """Failed runs as answers under pressure, completed ones as pages that don't exist."""
    kind = F.col("event_type")
    status = F.when(kind == "run.failed", 503).when(kind == "run.completed", 404).otherwise(200)
    log = t.run_events().select(F.col("user_id").cast("string").alias("host"), "sequence", ~kind.isin("run.failed", "run.completed"), status.alias("status"))
    return E.host_pressure(log.toDF("host", "sequence", "ok", "status"), 2, 4.0, 3)


@query("model_cursor", "SELECT pool, sequence, CASE WHEN moves < 5 THEN moves END AS model, CASE WHEN moves >= 5 THEN 'model_pool_exhausted' END AS failure FROM (SELECT user_id AS pool, sequence, CAST(coalesce(sum(CASE WHEN event_type IN ('run.failed', 'message.completed') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS moves FROM run_events)")
def model_cursor(t):
    c = t.run_events().select(F.col("user_id").alias("pool"), "sequence", F.col("event_type").alias("error"))
    return E.model_cursor(c, 5, ["RUN.failed", "message.completed"]).select("pool", "sequence", "model", "failure")


@query("backoff", "SELECT l_orderkey, l_linenumber, least(1.5 * pow(2, l_linenumber - 1), 30.0) AS wait FROM lineitem")
def backoff(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", E.backoff(F.col("l_linenumber"), 1.5, 30.0).alias("wait"))


@query("sse_frames", "SELECT sequence, 'id: ' || sequence || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || payload || chr(10) || chr(10) AS frame FROM run_events")
def sse_frames(t):
    return t.run_events().select("sequence", E.sse_frame(F.col("sequence"), F.col("event_type"), F.col("payload")).alias("frame"))


@query("sse_parse", "SELECT sequence, CASE WHEN sequence % 5 <> 1 THEN CAST(sequence AS VARCHAR) END AS id, CASE WHEN sequence % 5 <> 1 THEN event_type END AS event, CASE WHEN sequence % 5 = 0 THEN replace(payload, ': ', chr(10) || ': ') WHEN sequence % 5 <> 1 THEN payload END AS data FROM run_events")
def sse_parse(t):
    k = F.pmod("sequence", F.lit(5))
    good = E.sse_frame(F.col("sequence"), F.col("event_type"), F.col("payload"))
    two = F.replace(good, F.lit('"k": '), F.lit('"k"\ndata: : '))
    frame = F.when(k == 0, two).when(k == 1, F.lit("event: x\ndata: {broken\n\n")).otherwise(F.concat(F.lit(": keep-alive\n"), good))
    return t.run_events().select("sequence", E.sse_parse(frame).alias("p")).select("sequence", "p.id", "p.event", "p.data")


@query("wire_events", f"WITH e AS (SELECT run_id, sequence, event_type FROM run_events WHERE sequence % 7 <> 3), d AS (SELECT run_id, min(sequence) AS last FROM e WHERE event_type IN {TERM} GROUP BY 1), s AS (SELECT run_id, sequence AS id, CASE event_type WHEN 'route.resolved' THEN 'status' WHEN 'message.delta' THEN 'text' WHEN 'message.completed' THEN 'sources' WHEN 'run.failed' THEN 'run_failed' END AS kind FROM e LEFT JOIN d USING (run_id) WHERE last IS NULL OR sequence <= last UNION ALL SELECT run_id, NULL, 'run_failed' FROM (SELECT DISTINCT run_id FROM e) WHERE run_id NOT IN (SELECT run_id FROM d)) SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY id NULLS LAST) AS INTEGER) AS n, id, kind FROM s WHERE kind IS NOT NULL")
def wire_events(t):
    """What a client shows of each run: its events come over two connections, the second of
    which begins with all that the first had sent."""
    known = {"route.resolved": "status", "message.delta": "text", "message.completed": "sources", "run.failed": "run_failed"}
    e = t.run_events().where("sequence % 7 <> 3").select("run_id", F.col("sequence").alias("ord"), F.col("sequence").alias("id"), "event_type")
    half = e.groupBy("run_id").agg(F.percentile_approx("ord", 0.5).alias("half"))
    first = e.join(half, "run_id").where("ord <= half").drop("half").withColumn("attempt", F.lit(0))
    return W.client_events(first.unionByName(e.withColumn("attempt", F.lit(1))), "run_id", known, E.TERMINAL)


def _queue(t):
    o = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("DISCOVERED", "PENDING", "CLAIMED", "FETCHED")]), (F.pmod(o, F.lit(4)) + 1).cast("int"))
    us = micros("o_orderdate")
    return t("orders").select(o.alias("id"), "o_custkey", status.alias("status"), F.pmod(o, F.lit(9)).alias("priority"), F.pmod(F.col("o_custkey"), F.lit(5)).alias("depth"), us.alias("created_us"), us.alias("claimed_us"), F.when(F.pmod(o, F.lit(3)) == 0, us + 86_400_000_000).alias("next_us"), F.pmod(o, F.lit(4)).cast("int").alias("retry_count"), F.element_at(F.array(*[F.lit(s) for s in ("fetched", "parsed", "failed", "ignored")]), (F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int")).alias("outcome"))


QUEUE = "WITH q AS (SELECT o_orderkey AS id, o_custkey, ['DISCOVERED', 'PENDING', 'CLAIMED', 'FETCHED'][o_orderkey % 4 + 1] AS status, o_orderkey % 9 AS priority, o_custkey % 5 AS depth, epoch_us(o_orderdate) AS us, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) + 86400000000 END AS next_us, o_orderkey % 4 AS retry_count, ['fetched', 'parsed', 'failed', 'ignored'][o_custkey % 4 + 1] AS outcome FROM orders) "


NOW = 900_000_000_000_000


@query("enqueue_new", "SELECT o_custkey, min(o_orderkey) AS id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 500) GROUP BY 1")
def enqueue_new(t):
    q = _queue(t).select("o_custkey", "id")
    return E.enqueue(q.where("id < 500"), q, ["o_custkey"], "id")


@query("claim_batch", QUEUE + f"SELECT id, priority, depth FROM q WHERE (status IN ('DISCOVERED', 'PENDING') OR (status = 'CLAIMED' AND us < {NOW} - 900000000)) AND (next_us IS NULL OR next_us <= {NOW}) ORDER BY priority, depth, us, id LIMIT 200")
def claim_batch(t):
    return E.claim(_queue(t), F.lit(NOW), 900_000_000, 200).select("id", "priority", "depth")


@query("queue_transition", QUEUE + f"SELECT id, CASE outcome WHEN 'fetched' THEN 'FETCHED' WHEN 'parsed' THEN 'PARSED' WHEN 'ignored' THEN 'IGNORED' ELSE CASE WHEN retry_count + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END END AS new_status, CAST(retry_count + CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END AS INTEGER) AS new_retry, CASE outcome WHEN 'parsed' THEN {NOW} + 604800000000 WHEN 'failed' THEN {NOW} + CAST(pow(2, least(retry_count, 5)) * 60000000 AS BIGINT) END AS next_us FROM q")
def queue_transition(t):
    return E.transition(_queue(t).drop("next_us"), "outcome", F.lit(NOW)).select("id", "new_status", "new_retry", "next_us")


@query("crawl_order", "WITH r AS (SELECT page_id, row_number() OVER (ORDER BY contains(url, 'utm_') DESC, url DESC, page_id) AS rn FROM pages) SELECT page_id, (rn - 1) // 8 AS batch FROM r WHERE rn <= 200")
def crawl_order(t):
    order = [F.desc(F.col("url").contains("utm_")), F.desc("url"), F.col("page_id")]
    return E.crawl_order(t("pages").select("page_id", "url"), order, pages=200, batch=8).select("page_id", "batch")


@query("events_tumbling", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")
def events_tumbling(t):
    g = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return g.select(micros("w.start").alias("start_us"), "event_type", "n", "v")


@query("events_session", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s")
def events_session(t):
    g = t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", micros("w.start").alias("start_us"), "n")


@query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    """The same windows from a stream with a watermark, run to its end."""
    return S.run_to_end(S.tumbling(S.source(t.spark, t.path, "events")), "stream_tumbling", "complete")


@query("stream_terminal_once", f"SELECT run_id, min(sequence) AS sequence FROM run_events WHERE event_type IN {TERM} GROUP BY 1")
def stream_terminal_once(t):
    """First terminal event of each run from a stream with state."""
    told = S.run_to_end(S.first_terminals(S.run_events(S.source(t.spark, t.path, "events"))), "stream_terminal_once", "update")
    return S.settled_terminals(told)


def _timed(t):
    """The event log as a stream with its microseconds."""
    e = S.run_events(S.source(t.spark, t.path, "events"))
    return e.withColumn("user_id", F.split("run_id", "-")[0].cast("long")).withColumn("at_us", F.unix_micros("created_at"))


SEEN = "w AS (SELECT max(epoch_us(created_at)) - 86400000000 AS mark FROM run_events), "


@query("stream_idempotency", f"""WITH RECURSIVE {SEEN} e AS (SELECT user_id, event_type, sequence, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(created_at), sequence) AS n FROM run_events, w WHERE epoch_us(created_at) <= mark),
f AS (SELECT user_id, event_type, sequence, n, us + 36000000000 AS until, true AS reserved FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_type, e.sequence, e.n, CASE WHEN e.us >= f.until THEN e.us + 36000000000 ELSE f.until END, e.us >= f.until FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
SELECT user_id, event_type, sequence, reserved FROM f""")
def stream_idempotency(t):
    """Reservations from a stream, for all that the watermark (a day) has passed."""
    told = S.run_to_end(ST.reservations(_timed(t), ["user_id", "event_type"], 36_000_000_000, "1 day"), "stream_idempotency", "append")
    return told.select("user_id", "event_type", "sequence", "reserved")


@query("stream_login_limit", f"""WITH RECURSIVE {SEEN} e AS (SELECT user_id, sequence, epoch_us(created_at) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(created_at), sequence) AS n FROM run_events, w WHERE epoch_us(created_at) <= mark),
f AS (SELECT user_id, sequence, at_us, n, at_us AS st, 1 AS c FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.sequence, e.at_us, e.n, CASE WHEN e.at_us - f.st >= 86400000000 THEN e.at_us ELSE f.st END, CASE WHEN e.at_us - f.st >= 86400000000 THEN 1 ELSE f.c + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, sequence, at_us, c <= 3 AS allowed FROM f""")
def stream_login_limit(t):
    """Attempts let through, from a stream, for all that the watermark (a day) has passed."""
    return S.run_to_end(ST.logins(_timed(t), 3, 86_400_000_000, "1 day"), "stream_login_limit", "append").select("user_id", "sequence", "at_us", "allowed")


@query("stream_run_state", f"WITH {SEEN} t AS (SELECT run_id, min(sequence) AS s FROM run_events WHERE event_type IN {TERM} GROUP BY 1), g AS (SELECT e.run_id, max(CASE WHEN e.sequence = t.s THEN e.event_type END) AS te, arg_max(e.event_type, e.sequence) AS l, count(*) AS events, max(epoch_us(created_at)) AS last_us FROM run_events e LEFT JOIN t USING (run_id) GROUP BY 1) SELECT run_id, events, CASE WHEN te = 'run.completed' THEN 'COMPLETED' WHEN te = 'run.cancelled' THEN 'CANCELLED' WHEN te IS NOT NULL OR last_us + 172800000000 <= mark THEN 'FAILED' WHEN l = 'route.resolved' THEN 'RETRIEVING' WHEN l IN ('message.delta', 'message.completed') THEN 'GENERATING' ELSE 'ROUTING' END AS state, CASE WHEN te IS NULL AND last_us + 172800000000 <= mark THEN 'server_restarted' END AS code FROM g, w")
def stream_run_state(t):
    """States of runs from a stream; one that was silent for two days has failed."""
    parts = S.run_parts(S.run_events(S.source(t.spark, t.path, "events")), "1 day")
    return S.settled_runs(S.run_to_end(parts, "stream_run_state", "update"), "2 days", "1 day")


@query("event_append", "SELECT message_id, (SELECT max(sequence) FROM run_events) + row_number() OVER (ORDER BY session_id, turn) AS sequence FROM messages")
def event_append(t):
    """Messages appended to the log as events."""
    batch = t.messages().select("message_id", "session_id", "turn")
    return W.appended(t.run_events(), batch, ["session_id", "turn"]).select("message_id", "sequence")


@query("fan_out_lag", "WITH s AS (SELECT user_id, event_id, event_type <> 'view' AS p, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM s), l AS (SELECT *, bool_or(p AND depth > 32) OVER (PARTITION BY user_id ORDER BY event_id) AS lost FROM d) SELECT user_id, count(*) FILTER (WHERE p) AS published, count(*) FILTER (WHERE p AND NOT lost) AS delivered, bool_or(lost) AS dropped FROM l GROUP BY 1")
def fan_out_lag(t):
    """A user reads whenever it views; all its other events are published to it."""
    log = t("events").select(F.col("user_id").alias("subscriber"), F.col("event_id").alias("ord"), (F.col("event_type") != "view").alias("published"))
    p, d = F.col("published"), F.col("delivered")
    return W.fan_out(log).groupBy(F.col("subscriber").alias("user_id")).agg(F.count_if(p).alias("published"), F.count_if(d).alias("delivered"), F.max(p & ~d).alias("dropped"))


def completion_lines(t):
    """Each answer as the lines of a streamed completion, a word a chunk. Every seventh session
    breaks off before the end mark, every eleventh starts with a broken chunk."""
    m = t.messages().where("role = 'assistant'").select(F.col("message_id").alias("stream"), "session_id", F.split(F.coalesce("content", F.lit("")), " ", -1).alias("words"))
    chunk = lambda words: F.to_json(F.struct(F.array(F.struct(F.struct(words.alias("content")).alias("delta"))).alias("choices")))
    head = F.when(F.col("session_id") % 11 == 0, F.array(F.lit("data: {broken"))).otherwise(F.array(F.lit(": keep-alive"), F.lit("")))
    told = F.transform("words", lambda w, i: F.concat(F.lit("data:"), chunk(F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))))
    usage = F.format_string('data: {"model": "m1", "choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": %d}}', F.size("words"))
    tail = F.when(F.col("session_id") % 7 == 0, F.array(usage)).otherwise(F.array(usage, F.lit("data: [DONE]"), F.concat(F.lit("data: "), chunk(F.lit("late")))))
    return m.select("stream", F.posexplode(F.concat(head, told, tail)).alias("ord", "line"))


@query("token_stream", "WITH r AS (SELECT message_id AS stream, coalesce(content, '') AS c, CASE WHEN session_id % 11 = 0 THEN 'invalid_stream' WHEN session_id % 7 = 0 THEN 'stream_incomplete' ELSE '' END AS error FROM messages WHERE role = 'assistant') SELECT stream, CASE WHEN error = '' THEN c END AS content, CASE WHEN error = '' THEN 'm1' END AS model, CAST(CASE WHEN error = '' THEN 3 END AS BIGINT) AS input_tokens, CAST(CASE WHEN error = '' THEN len(string_split(c, ' ')) END AS BIGINT) AS output_tokens, error FROM r")
def token_stream(t):
    return W.stream_results(completion_lines(t), "m0")


@query("token_deltas", "SELECT stream, count(*) AS deltas, CAST(sum(length(w) + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS BIGINT) AS chars FROM (SELECT message_id AS stream, unnest(string_split(coalesce(content, ''), ' ')) AS w, generate_subscripts(string_split(coalesce(content, ''), ' '), 1) AS i FROM messages WHERE role = 'assistant' AND session_id % 11 <> 0) WHERE i > 1 OR w <> '' GROUP BY 1")
def token_deltas(t):
    return W.stream_deltas(completion_lines(t)).groupBy("stream").agg(F.count("*").alias("deltas"), F.sum(F.char_length("delta")).alias("chars"))
