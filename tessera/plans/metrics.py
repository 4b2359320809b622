"""Queries over the event log and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import store as ST
from .registry import query

START, END, ZONE = "2024-01-03 00:00:00", "2024-01-20 00:00:00", "Asia/Shanghai"
FACTS = """WITH ef AS (SELECT run_id, max(payload->>'$.k') FILTER (WHERE event_type = 'route.resolved') AS route, min(created_at) FILTER (WHERE event_type = 'message.delta') AS fd,
  min(created_at) FILTER (WHERE event_type IN ('run.completed', 'run.failed')) AS te, max(payload->>'$.k') FILTER (WHERE event_type = 'message.completed') AS msg FROM run_events GROUP BY 1),
rf AS (SELECT r.run_id, r.status, r.error_code, coalesce(route, '') AS route, coalesce(msg, '') AS assistant_message_id,
  (epoch_us(te) - epoch_us(r.created_at)) / 1000.0::DOUBLE AS latency_ms, (epoch_us(fd) - epoch_us(r.created_at)) / 1000.0::DOUBLE AS ttft_ms FROM agent_runs r LEFT JOIN ef USING (run_id)) """


def facts(t):
    return M.run_facts(t.agent_runs(), t.run_events())


@query("run_facts", FACTS + "SELECT run_id, status, error_code, route, assistant_message_id, round(latency_ms, 3) AS latency_ms, round(ttft_ms, 3) AS ttft_ms FROM rf")
def run_facts(t):
    return facts(t).withColumns({"latency_ms": F.round("latency_ms", 3), "ttft_ms": F.round("ttft_ms", 3)})


@query("run_quality", FACTS + """SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'COMPLETED') AS completed_runs, count(*) FILTER (WHERE status = 'FAILED') AS failed_runs, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_runs,
count(*) FILTER (WHERE status = 'COMPLETED' AND route <> 'controlled' AND assistant_message_id <> '' AND assistant_message_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)) AS no_source_answers,
round(coalesce(avg(latency_ms), 0), 4) AS avg_latency_ms, round(coalesce(quantile_cont(latency_ms, 0.5), 0), 6) AS p50_latency_ms, round(coalesce(quantile_cont(latency_ms, 0.95), 0), 6) AS p95_latency_ms,
round(coalesce(avg(ttft_ms), 0), 4) AS avg_ttft_ms, round(coalesce(quantile_cont(ttft_ms, 0.95), 0), 6) AS p95_ttft_ms FROM rf""")
def run_quality(t):
    cited = t("labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("message_id"))
    return M.run_quality(facts(t), cited)


@query("user_retention", f"""WITH c AS (SELECT user_id, CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, created_at < TIMESTAMP '{END}' - INTERVAL 1 DAY AS e1, created_at < TIMESTAMP '{END}' - INTERVAL 7 DAY AS e7 FROM users WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'),
a AS (SELECT user_id, CAST(created_at + INTERVAL 8 HOUR AS DATE) AS seen FROM run_events),
r AS (SELECT c.*, EXISTS (SELECT 1 FROM a WHERE a.user_id = c.user_id AND a.seen = c.day + 1) AS r1, EXISTS (SELECT 1 FROM a WHERE a.user_id = c.user_id AND a.seen = c.day + 7) AS r7 FROM c)
SELECT (SELECT count(*) FROM users WHERE created_at < TIMESTAMP '{END}') AS total_registered, (SELECT count(DISTINCT user_id) FROM run_events WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}') AS active_users,
count(*) AS new_registered, count(*) FILTER (WHERE e1) AS d1_eligible, count(*) FILTER (WHERE e1 AND r1) AS d1_retained, count(*) FILTER (WHERE e7) AS d7_eligible, count(*) FILTER (WHERE e7 AND r7) AS d7_retained FROM r""")
def user_retention(t):
    return M.user_retention(t.users(), t.run_events(), START, END, ZONE)


@query("engagement", f"SELECT count(*) AS questions, count(DISTINCT session_id) AS active_sessions FROM messages WHERE role = 'user' AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'")
def engagement(t):
    return M.engagement(t.messages(), START, END)


@query("cost_metrics", "SELECT round(coalesce(sum(l_quantity), 0), 2) AS input_tokens, round(coalesce(sum(l_extendedprice), 0), 2) AS cost, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def cost_metrics(t):
    usage = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("input_tokens"), F.col("l_extendedprice").alias("cost"))
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("session_id"))
    sessions = t("customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("school_id"))
    return M.cost_metrics(usage, runs, sessions, "BUILDING").withColumn("input_tokens", F.round("input_tokens", 2))


@query("route_breakdown", FACTS + "SELECT CASE WHEN route = '' THEN 'unresolved' ELSE route END AS name, count(*) AS n FROM rf GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def route_breakdown(t):
    return M.breakdown(facts(t), "route", "unresolved")


@query("error_breakdown", "SELECT error_code AS name, count(*) AS n FROM agent_runs WHERE error_code <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def error_breakdown(t):
    return M.breakdown(t.agent_runs(), "error_code")


@query("top_questions", r"SELECT left(regexp_replace(trim(text), '[ \t\n\v\f\r]+', ' ', 'g'), 200) AS question, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, question LIMIT 10")
def top_questions(t):
    return M.top_questions(t("documents").select(F.lit("user").alias("role"), F.col("text").alias("content")))


@query("daily_series", f"""WITH d AS (SELECT CAST(unnest(generate_series(CAST(TIMESTAMP '{START}' + INTERVAL 8 HOUR AS DATE), CAST(TIMESTAMP '{END}' - INTERVAL 1 MICROSECOND + INTERVAL 8 HOUR AS DATE), INTERVAL 1 DAY)) AS DATE) AS day),
u AS (SELECT CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS new_users FROM users WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1),
m AS (SELECT CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS questions, count(DISTINCT user_id) AS active_users FROM messages WHERE role = 'user' AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1),
r AS (SELECT CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM agent_runs WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(new_users, 0) AS new_users, coalesce(active_users, 0) AS active_users, coalesce(questions, 0) AS questions, coalesce(runs, 0) AS runs, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed FROM d LEFT JOIN u USING (day) LEFT JOIN m USING (day) LEFT JOIN r USING (day)""")
def daily_series(t):
    return M.daily_series(t.users(), t.messages(), t.agent_runs(), START, END, ZONE)


@query("overview_rates", "SELECT status, count(*) AS n, round(CASE WHEN count(*) FILTER (WHERE error_code <> '') = 0 THEN 0.0 ELSE count(*) / count(*) FILTER (WHERE error_code <> '') END, 6) AS rate FROM agent_runs GROUP BY 1")
def overview_rates(t):
    g = t.agent_runs().groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("error_code") != "").alias("e"))
    return g.select("status", "n", F.round(M.ratio(F.col("n"), F.col("e")), 6).alias("rate"))


@query("call_cost", "SELECT l_returnflag, CAST(sum(CAST(round(l_quantity * 2.5) AS BIGINT)) AS BIGINT) AS cost_micro FROM lineitem GROUP BY 1")
def call_cost(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.sum(M.call_cost(F.col("l_quantity"), 2.5)).alias("cost_micro"))


@query("status_counts", "SELECT user_id, status, count(*) AS n, count(*) FILTER (WHERE status <> 'QUEUED') AS processed FROM agent_runs GROUP BY 1, 2")
def status_counts(t):
    return ST.status_counts(t.agent_runs(), ["user_id"], "status", ["QUEUED"])


@query("breakdown_share", "SELECT event_type AS name, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def breakdown_share(t):
    return ST.breakdown(t("events"), F.col("event_type"))


@query("chart_scale", "WITH m AS (SELECT greatest(1.0, CAST(max(value) AS DOUBLE)) AS m FROM events) SELECT ceil(m / pow(10, floor(log10(m)))) * pow(10, floor(log10(m))) AS scale FROM m")
def chart_scale(t):
    return M.chart_scale(t("events"), "value")


@query("series_valid", "WITH l AS (SELECT event_type AS series, event_id, value, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id, value) AS b FROM events) SELECT series, count(*) FILTER (WHERE event_id <= b) AS unordered, count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value) OR value < 0) AS invalid, count(*) AS points FROM l GROUP BY 1")
def series_valid(t):
    return M.series_faults(t("events"), "event_id", "value", F.col("event_type"))


@query("history_sections", "SELECT strftime(created_at, '%Y-%m-%d') AS label, min(session_id * 1000 + turn) AS first_ord, string_agg(message_id, ',' ORDER BY session_id * 1000 + turn) AS items FROM messages GROUP BY 1")
def history_sections(t):
    m = t.messages().withColumn("ord", F.col("session_id") * 1000 + F.col("turn"))
    return M.sections(m, F.date_format("created_at", "yyyy-MM-dd"), "ord", "message_id")


@query("eval_gate", "WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' WHEN 'purchase' THEN 'pass' WHEN 'click' THEN 'pass' ELSE 'run' END AS outcome FROM events), p AS (SELECT user_id % 1000 AS id, arg_max(outcome, event_id) AS last, bool_or(outcome = 'skip') AS skipped FROM o GROUP BY 1) SELECT CASE WHEN skipped THEN 'skipped' WHEN last = 'pass' THEN 'passed' WHEN last = 'fail' THEN 'failed' ELSE 'missing' END AS status, count(*) AS n FROM p GROUP BY 1")
def eval_gate(t):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "fail").when(kind == "signup", "skip").when(kind.isin("purchase", "click"), "pass").otherwise("run")
    e = t("events").select(F.pmod("user_id", F.lit(1000)).alias("id"), "event_id", outcome.alias("outcome"))
    return M.gate(e, "id", "event_id", "outcome")
