"""Queries over files, versions, ownership, tokens and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import admission as A
from ..operators import config
from ..operators import events as E
from ..operators import rules as R
from ..operators import timetable as T
from ..operators.metrics import micros
from ..sources import files as S
from .evidence import PAGE, _plain, normalized
from .registry import query

NOW = 1_705_000_000_000_000


@query("url_minimal", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '//([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '//[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '//[^/?#]*([^?#]*)', 1) END || CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN '?' || regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) ELSE '' END AS url FROM pages")
def url_minimal(t):
    u = F.btrim("url")
    full = F.concat(U.scheme(u), F.lit("://"), F.lower(U.authority(u)), F.when(U.path(u) == "", "/").otherwise(U.path(u)), F.when(U.query(u) != "", F.concat(F.lit("?"), U.query(u))).otherwise(""))
    return t("pages").select("page_id", full.alias("url"))


@query("department_hint", r"SELECT doc_id, trim(split_part(regexp_extract(text, '(?s)Licensed under (.{0,60})', 1), chr(10), 1), ' ：:|') AS department FROM documents")
def department_hint(t):
    return t("documents").select("doc_id", X.after_hint("text", ["Licensed under "]).alias("department"))


@query("outline", _plain(PAGE + "SELECT page_id, CASE WHEN big THEN plain(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)', 1), '[ \\t]+', ' ', 'g'))) ELSE '' END AS outline FROM main"))
def outline(t):
    """Headings of the pages' Markdown."""
    return normalized(t).select("page_id", F.array_join(X.outline("markdown"), "|").alias("outline"))


@query("snippet_around", r"WITH p AS (SELECT doc_id, text, instr(text, '@') - 1 AS a FROM documents WHERE contains(text, '@')) SELECT doc_id, trim(regexp_replace(substr(text, CAST(greatest(a - 40, 0) + 1 AS BIGINT), CAST(least(a + 1 + 40, length(text)) - greatest(a - 40, 0) AS BIGINT)), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS snippet FROM p")
def snippet_around(t):
    at = F.instr("text", "@") - 1
    return t("documents").where(F.col("text").contains("@")).select("doc_id", X.snippet_around("text", at, at + 1).alias("snippet"))


@query("media_type", "SELECT page_id, CASE WHEN ends_with(lower(regexp_extract(url, '//[^/?#]*([^?#]*)', 1)), '.txt') THEN 'text/plain' ELSE 'text/html' END AS media_type FROM pages")
def media_type(t):
    return t("pages").select("page_id", X.media_type(U.path(F.col("url"))).alias("media_type"))


TYPE = "CASE WHEN n_chars > 5000 THEN 'regulation' WHEN n_chars > 2500 THEN 'guide' ELSE 'notice' END"


def typed(t):
    n = F.col("n_chars")
    return t("documents").withColumn("document_type", F.when(n > 5000, "regulation").when(n > 2500, "guide").otherwise("notice"))


@query("version_status", f"SELECT doc_id, CASE WHEN {TYPE} <> 'notice' AND doc_id % 3 = 0 THEN 'current_unverified_date' WHEN doc_id % 5 = 0 THEN 'latest_observed' ELSE 'historical' END AS version_status, CASE WHEN source = 'src1' THEN 'COLLEGE_ONLY' WHEN {TYPE} <> 'notice' THEN 'TIMELESS_POLICY' ELSE 'DATED_SOURCE_ONLY' END AS answer_scope FROM documents")
def version_status(t):
    k = F.col("doc_id")
    d = typed(t).withColumns({"published": F.when(k % 3 != 0, "2024-01-01"), "college": F.when(F.col("source") == "src1", "c")})
    return d.select(k, R.version_status(F.col("document_type"), F.col("published"), k % 5 == 0).alias("version_status"), R.answer_scope(F.col("college"), F.col("document_type")).alias("answer_scope"))


SUB = [("has_mail", "@mail"), ("has_licence", "[Ll]icen[cs]e"), ("has_token", "token"), ("has_table", r" \| ")]


@query("subtopics", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in SUB) + "], lambda x: x IS NOT NULL), ',') AS subtopics FROM documents")
def subtopics(t):
    return t("documents").select("doc_id", F.array_join(R.labels(F.col("text"), SUB), ",").alias("subtopics"))


@query("authority", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'OFFICIAL_COLLEGE' WHEN contains(lower(p_type), 'brass') THEN 'OFFICIAL_SCHOOL' ELSE 'OFFICIAL_DEPARTMENT' END AS authority FROM part")
def authority(t):
    level = F.replace(F.replace(F.lower("p_type"), F.lit("steel"), F.lit("college")), F.lit("brass"), F.lit("policy"))
    return t("part").select("p_partkey", R.authority(level).alias("authority"))


@query("question_route", "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'KNOWLEDGE_PLUS_LIVE_EVAL' WHEN '2-HIGH' THEN 'STATIC_KNOWLEDGE_EVAL' ELSE 'MANUAL_REVIEW' END AS route, count(*) AS n FROM orders GROUP BY 1, 2")
def question_route(t):
    r = R.question_route(F.col("o_orderpriority"), {"1-URGENT": "KNOWLEDGE_PLUS_LIVE_EVAL", "2-HIGH": "STATIC_KNOWLEDGE_EVAL"})
    return t("orders").groupBy("o_orderpriority", r.alias("route")).agg(F.count("*").alias("n"))


@query("personnel_sheet", "SELECT source, count(*) FILTER (WHERE contains(text, ' | ') AND regexp_matches(text, 'token|@mail')) AS released FROM documents GROUP BY 1")
def personnel_sheet(t):
    x = F.col("text")
    return t("documents").groupBy("source").agg(F.count_if(x.contains(" | ") & x.rlike("token|@mail")).alias("released"))


@query("policy_rewrite", "SELECT doc_id, CASE WHEN source = 'src2' AND n_chars > 2000 THEN 'library' WHEN source = 'src2' THEN 'card' ELSE lang END AS lang, CASE WHEN source = 'src2' AND n_chars > 2000 THEN 'lib' ELSE source END AS source FROM documents")
def policy_rewrite(t):
    s, n = F.col("source") == "src2", F.col("n_chars")
    return R.rewritten(t("documents"), [(s & (n > 2000), {"lang": "library", "source": "lib"}), (s, {"lang": "card"})]).select("doc_id", "lang", "source")


@query("run_owner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def run_owner(t):
    return t("orders").where("o_orderstatus = 'F'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


TOK = f"WITH tok AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS token_hash, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'refresh' ELSE 'access' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 1::BIGINT END AS revoked_us, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE {NOW} + 5 END AS expires_us, o_orderkey FROM orders), usr AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment <> 'MACHINERY') "


def _tokens(t):
    k = F.col("o_orderkey")
    tok = t("orders").select(F.sha2(k.cast("string"), 256).alias("token_hash"), F.col("o_custkey").alias("user_id"), F.when(k % 2 == 0, "refresh").otherwise("access").alias("kind"), F.when(k % 7 == 0, F.lit(1).cast("long")).alias("revoked_us"), F.when(k % 3 == 0, F.lit(0).cast("long")).otherwise(F.lit(NOW + 5)).alias("expires_us"), k)
    usr = t("customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "blocked").otherwise("active").alias("status"))
    return tok, usr


@query("token_valid", TOK + f"SELECT token_hash, user_id FROM tok JOIN usr USING (user_id) WHERE kind = 'access' AND revoked_us IS NULL AND expires_us > {NOW}")
def token_valid(t):
    tok, usr = _tokens(t)
    return E.live_tokens(tok, usr, F.lit(NOW), "access").select("token_hash", "user_id")


@query("token_rotate", TOK + f", v AS (SELECT tok.token_hash, user_id FROM tok JOIN usr USING (user_id) WHERE kind = 'refresh' AND revoked_us IS NULL AND expires_us > {NOW} AND o_orderkey % 4 = 0) SELECT token_hash, user_id, kind, CASE WHEN token_hash IN (SELECT token_hash FROM v) THEN {NOW} ELSE revoked_us END AS revoked_us, expires_us FROM tok UNION ALL SELECT sha256(token_hash || chr(0) || k), user_id, k, NULL, {NOW} + CASE k WHEN 'access' THEN 900 ELSE 9000 END FROM (SELECT *, unnest(['access', 'refresh']) AS k FROM v)")
def token_rotate(t):
    tok, usr = _tokens(t)
    used = tok.where("o_orderkey % 4 = 0").select("token_hash")
    return E.rotated(tok.drop("o_orderkey"), usr, used, F.lit(NOW), 900, 9000)


@query("attempt_log", "SELECT user_id AS url_id, event_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS attempt, left(props, 2000) AS error_message FROM events WHERE event_type = 'error'")
def attempt_log(t):
    c = t("events").where("event_type = 'error'").select(F.col("user_id").alias("url_id"), F.col("event_id").alias("sequence"), micros("ts").alias("started_us"), F.col("props").alias("error_message"))
    return E.attempts(c).select("url_id", "sequence", F.col("attempt").cast("long").alias("attempt"), "error_message")


@query("canary_export", "SELECT d.doc_id, d.source_id, a.attachment_id, 'doc-' || d.doc_id || '.md' AS file FROM kb_documents d LEFT JOIN kb_attachments a ON a.doc_id = d.doc_id AND a.ord = 1 WHERE d.review_status = 'ACCEPTED' AND NOT d.pii_detected")
def canary_export(t):
    return A.export_rows(t.kb_documents(), t.kb_attachments())


@query("timetable_valid", "SELECT *, repeated_ids = 0 AND NOT mixed_source AND out_of_range = 0 AS valid FROM (SELECT p_brand, CAST(count(*) - count(DISTINCT p_partkey // 2) AS BIGINT) AS repeated_ids, count(DISTINCT p_type) > 1 AS mixed_source, count(*) FILTER (WHERE p_size NOT BETWEEN 1 AND 45) AS out_of_range FROM part GROUP BY 1)")
def timetable_valid(t):
    """Parts as rows of timetables, two of neighbouring keys with one id."""
    p = t("part").withColumn("id", F.floor(F.col("p_partkey") / 2))
    return T.snapshot_faults(p, "p_brand", "id", "p_type", F.col("p_size"), F.col("p_size"), 45)


@query("mock_route", "SELECT conv_id, turn, CASE WHEN contains(lower(trim(text)), 'idiot') THEN 'mock_failure_test' WHEN contains(lower(text), 'worthless') THEN 'no_reliable_source' WHEN contains(text, 'with') THEN 'freshness_requires_official_search' ELSE 'no_retrieval_required_for_integration' END AS reason FROM conversations")
def mock_route(t):
    x = F.lower(F.btrim("text"))
    return t("conversations").select("conv_id", "turn", X.first_match([("mock_failure_test", x.contains("idiot")), ("no_reliable_source", x.contains("worthless")), ("freshness_requires_official_search", F.col("text").contains("with"))], "no_retrieval_required_for_integration").alias("reason"))


@query("archive_contract", "SELECT 'a' || page_id || '.zip' AS path, CASE WHEN page_id % 9 = 4 THEN 0 ELSE 2 END AS members, CASE page_id % 9 WHEN 4 THEN 'not_an_archive' WHEN 2 THEN 'duplicate_archive_member:a.txt' WHEN 3 THEN 'unsafe_archive_member:../b' ELSE '' END AS fault FROM pages")
def archive_contract(t):
    import io
    import warnings
    import zipfile

    import pyarrow as pa

    def pack(stream):
        warnings.simplefilter("ignore")
        for b in stream:
            out = []
            for i in b.column(0).to_pylist():
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w") as z:
                    z.writestr("a.txt", str(i))
                    z.writestr({2: "a.txt", 3: "../b"}.get(i % 9, "b.txt"), "x")
                out.append(f.getvalue() if i % 9 != 4 else b"no")
            yield pa.RecordBatch.from_arrays([pa.array([f"a{i}.zip" for i in b.column(0).to_pylist()], pa.string()), pa.array(out, pa.binary())], names=["path", "content"])

    files = t("pages").select("page_id").mapInArrow(pack, "path string, content binary")
    return S.archive_contract(files).select("path", "members", "fault")


@query("file_parse", "SELECT page_id || CASE page_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' ELSE '.pdf' END AS path, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | x y |' ELSE '' END AS text, CASE page_id % 3 WHEN 2 THEN 'unsupported_or_image' ELSE '' END AS flag FROM pages")
def file_parse(t):
    k = F.col("page_id")
    path = F.concat(k.cast("string"), F.when(k % 3 == 0, ".txt").when(k % 3 == 1, ".csv").otherwise(".pdf"))
    body = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.concat(F.lit("a,b\n"), k.cast("string"), F.lit(',"x y"\n'))).otherwise("%PDF")
    return S.parse_files(t("pages").select(path.alias("path"), body.cast("binary").alias("content")))


@query("delivery_packaging", "WITH l AS (SELECT source, doc_id // 4096 AS part, doc_id, doc_id || ':' || sha256(text) AS line FROM documents), p AS (SELECT source, part, sha256(string_agg(line, chr(10) ORDER BY doc_id)) AS digest, count(*) AS files FROM l GROUP BY 1, 2) SELECT source, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS digest, CAST(sum(files) AS BIGINT) AS files FROM p GROUP BY 1")
def delivery_packaging(t):
    """Digest of each source's files as a package's manifest lists them."""
    return X.tree_digest(t("documents"), "source", "doc_id", "text")


@query("review_plans", "WITH RECURSIVE p AS (SELECT n_nationkey AS plan, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey // 4 * 4 WHEN n_nationkey % 8 = 4 THEN n_nationkey - 4 END AS parent FROM nation), l AS (SELECT plan, plan AS at FROM p UNION ALL SELECT l.plan, p.parent FROM l JOIN p ON p.plan = l.at WHERE p.parent IS NOT NULL), m AS (SELECT l.plan, l.at, p.parent IS NULL AS root FROM l JOIN p ON p.plan = l.at), r AS (SELECT m.plan, count(*) AS reviews FROM m JOIN supplier ON s_nationkey = m.at GROUP BY 1), g AS (SELECT DISTINCT m.plan, c_custkey FROM m JOIN customer ON c_custkey % 25 = m.at WHERE NOT root AND c_custkey % 3 = 0), d AS (SELECT m.plan, count(*) AS decisions, sum(c_custkey) AS documents FROM m JOIN customer ON c_nationkey = m.at WHERE root AND NOT EXISTS (SELECT 1 FROM g WHERE g.plan = m.plan AND g.c_custkey = customer.c_custkey) GROUP BY 1) SELECT p.plan, coalesce(reviews, 0) AS reviews, coalesce(decisions, 0) AS decisions, CAST(coalesce(documents, 0) AS BIGINT) AS documents FROM p LEFT JOIN r ON r.plan = p.plan LEFT JOIN d ON d.plan = p.plan")
def review_plans(t):
    """Plans that extend others, two generations deep, with their reviews and decisions."""
    k = F.col("n_nationkey")
    plans = t("nation").select(k.alias("plan"), F.when(k % 4 > 0, F.floor(k / 4).cast("int") * 4).when(k % 8 == 4, k - 4).alias("parent"))
    reviews = t("supplier").select(F.col("s_nationkey").alias("plan"), F.col("s_suppkey").alias("review"))
    decisions = t("customer").select(F.col("c_nationkey").alias("plan"), F.col("c_custkey").alias("document_id"))
    drops = t("customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") % 25).cast("int").alias("plan"), F.col("c_custkey").alias("document_id"))
    return config.plan_tables(plans, reviews, decisions, drops)


@query("retained_bundles", "SELECT parent_id, count(*) AS children FROM relations WHERE child_id IN (SELECT doc_id FROM kb_documents WHERE review_status = 'ACCEPTED') GROUP BY 1")
def retained_bundles(t):
    ok = t.kb_documents().where("review_status = 'ACCEPTED'").select(F.col("doc_id").alias("child_id"))
    return A.bundles(t.relations().join(ok, "child_id", "left_semi")).select("parent_id", F.col("members").alias("children"))
