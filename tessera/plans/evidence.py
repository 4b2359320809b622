"""Queries over retrieval, ranking, citations, sessions and page parsing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..operators import dom as D
from ..operators import html as H
from ..operators import retrieval as R
from ..operators import store as ST
from ..sources.tables import settle
from ..sources.tables import zip_members as scan_zip
from .registry import query

FRESH = [("freshness_status_question", "le de|der und"), ("freshness_current_marker", "the of")]
SCHEDULE, DYNAMIC, STABLE = "with", "que|was", "that|les"
YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?: |-)()"
TAIL = "regexp_replace(text, '\\s+', ' ', 'g')"


def questions(t):
    q = F.regexp_replace("text", r"\s+", " ")
    return t("conversations").where("role = 'user'").select("conv_id", "turn", q.alias("q"))


LEVEL = f"SELECT conv_id, turn, q, CASE WHEN regexp_matches(q, 'le de|der und') THEN 'freshness_status_question' WHEN regexp_matches(q, 'the of') THEN 'freshness_current_marker' WHEN regexp_matches(q, 'with') THEN 'freshness_schedule_question' WHEN regexp_matches(q, 'que|was') AND NOT regexp_matches(q, 'that|les') THEN 'freshness_dynamic_information' ELSE 'stable_campus_knowledge' END AS reason FROM (SELECT conv_id, turn, {TAIL} AS q FROM conversations WHERE role = 'user')"


def fresh(t):
    return questions(t).withColumn("f", R.freshness(F.col("q"), 2024, FRESH, SCHEDULE, DYNAMIC, STABLE, YEAR))


@query("freshness_class", f"SELECT conv_id, turn, reason, CASE WHEN reason = 'stable_campus_knowledge' THEN 'STABLE' ELSE 'CURRENT' END AS level FROM ({LEVEL})")
def freshness_class(t):
    return fresh(t).select("conv_id", "turn", "f.level", "f.reason")


@query("route_plan", f"SELECT conv_id, turn, CASE WHEN length(q) < 30 THEN 'controlled' WHEN contains(q, 'Probe') THEN 'web_search' WHEN reason = 'stable_campus_knowledge' THEN 'knowledge' ELSE 'hybrid' END AS route FROM ({LEVEL})")
def route_plan(t):
    return fresh(t).select("conv_id", "turn", R.route(F.col("f.level"), F.char_length("q") < 30, F.lit(False), F.col("q").contains("Probe")).alias("route"))


@query("plan_valid", f"SELECT conv_id, turn, CASE WHEN length(q) < 30 THEN turn % 2 = 0 WHEN reason = 'stable_campus_knowledge' THEN true ELSE turn % 4 = 0 END AS valid FROM ({LEVEL})")
def plan_valid(t):
    r = R.route(F.col("f.level"), F.char_length("q") < 30, F.lit(False), F.lit(False))
    p = fresh(t).withColumn("route", r)
    v = R.plan_valid(F.col("route"), F.col("turn") % 2 == 0, F.when(F.col("route") == "hybrid", F.col("turn") % 4 == 0).otherwise(False), F.col("route").isin("knowledge", "hybrid"))
    return p.select("conv_id", "turn", v.alias("valid"))


@query("question_strip", f"SELECT conv_id, turn, trim(CASE WHEN conv_id % 5 = 2 THEN 'hi' || q ELSE q END) AS question FROM (SELECT conv_id, turn, {TAIL} AS q FROM conversations WHERE role = 'user')")
def question_strip(t):
    """Greetings and polite openings before the questions of the conversations."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("你好，请问", "Hello, ", "hi", "请问：", "")]), (F.pmod("conv_id", F.lit(5)) + 1).cast("int"))
    return questions(t).select("conv_id", "turn", R.stripped(F.concat(lead, "q")).alias("question"))


RES = """WITH res AS (SELECT m.knowledge_id, d.doc_id, s.source_id, s.source_name, s.official_url, coalesce(a.attachment_id, '') AS attachment_id, coalesce(a.name, '') AS attachment_name, coalesce(a.url, '') AS attachment_url FROM kb_mappings m JOIN kb_documents d ON d.doc_id = m.doc_id JOIN kb_sources s ON s.source_id = d.source_id LEFT JOIN kb_attachments a ON a.attachment_id = m.attachment_id AND a.doc_id = d.doc_id
WHERE m.import_status = 'IMPORTED' AND d.rag_eligible AND NOT d.pii_detected AND d.review_status = 'ACCEPTED' AND s.active AND (m.attachment_id IS NULL OR (a.attachment_id IS NOT NULL AND a.rag_eligible AND NOT a.pii_detected AND a.review_status = 'ACCEPTED'))) """


def resolved(t):
    return R.resolve(t.kb_mappings(), t.kb_documents(), t.kb_sources(), t.kb_attachments())


@query("resolve_evidence", RES + "SELECT * FROM res")
def resolve_evidence(t):
    return resolved(t).drop("content")


@query("doc_attachments", RES + ", l AS (SELECT doc_id, array_to_string(list(attachment_id ORDER BY ord, attachment_id), ',') AS list FROM kb_attachments WHERE rag_eligible AND NOT pii_detected AND review_status = 'ACCEPTED' GROUP BY 1) SELECT knowledge_id, res.doc_id, coalesce(list, attachment_id) AS attachments FROM res LEFT JOIN l ON l.doc_id = res.doc_id")
def doc_attachments(t):
    return R.attachment_lists(resolved(t), t.kb_attachments()).withColumn("attachments", F.array_join("attachments", ","))


@query("metadata_coalesce", "SELECT event_id, coalesce(nullif(props->>'$.title', ''), props->>'$.k', 'none') AS title, coalesce(TRY_CAST(props->>'$.k' AS BIGINT), -1) AS k FROM events")
def metadata_coalesce(t):
    return t("events").select("event_id", R.metadata_text("props", ["title", "k"], "none").alias("title"), R.metadata_long("props", ["k"], -1).alias("k"))


#: Candidates: for every source as a query its documents in order, some blank.
CAND = "cand AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ord, 'kb-' || doc_id AS knowledge_id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'c' || doc_id END AS chunk_id, doc_id FROM documents)"


def candidates(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    d = F.col("doc_id")
    return t("documents").select(F.col("source").alias("query_id"), F.row_number().over(w).alias("ord"), F.concat(F.lit("kb-"), d.cast("string")).alias("knowledge_id"), F.when(d % 13 == 0, " ").otherwise(F.concat(F.lit("c"), d.cast("string"))).alias("chunk_id"), F.col("text").alias("content"))


EVI = RES + f", {CAND}, evi AS (SELECT c.query_id, c.ord, c.knowledge_id, r.doc_id, r.source_id, CASE WHEN attachment_url <> '' THEN attachment_url ELSE official_url END AS source_url, 'src_kb_' || left(sha256('s1' || chr(0) || r.doc_id), 24) AS evidence_id, row_number() OVER (PARTITION BY c.query_id ORDER BY c.ord) AS rank FROM cand c JOIN res r USING (knowledge_id) WHERE trim(chunk_id) <> '') "


def evid(t):
    return R.evidence(candidates(t), resolved(t), ["example.org"], 4, "s1")


@query("kb_evidence", EVI + "SELECT query_id, knowledge_id, source_url, evidence_id, rank FROM evi WHERE rank <= 4")
def kb_evidence(t):
    return evid(t).select("query_id", "knowledge_id", "source_url", "evidence_id", F.col("rank").cast("long").alias("rank"))


@query("kb_candidates_topk", "SELECT query_id, knowledge_id, ord FROM (" + CAND.replace("cand AS (", "", 1) + " WHERE ord <= 3")
def kb_candidates_topk(t):
    return candidates(t).where("ord <= 3").select("query_id", "knowledge_id", F.col("ord").cast("long").alias("ord"))


@query("sources_group", "WITH i AS (SELECT source, doc_id, lang AS x FROM documents WHERE source <> 'src5') SELECT source, min(doc_id) AS first_ord, array_to_string(list_transform(list_sort(list(struct_pack(o := o, x := x))), lambda r: r.x), ',') AS excerpts FROM (SELECT source, x, min(doc_id) AS o FROM i GROUP BY 1, 2) JOIN (SELECT source AS s2, min(doc_id) AS doc_id FROM i GROUP BY 1) ON s2 = source GROUP BY 1")
def sources_group(t):
    i = t("documents").select(F.when(F.col("source") == "src5", "").otherwise(F.col("source")).alias("source"), "doc_id", "lang")
    return R.group_sources(i, "source", "doc_id", "lang").withColumn("excerpts", F.array_join("excerpts", ","))


@query("sources_merge", "WITH u AS (SELECT source, 0 AS grp, doc_id AS ord FROM documents WHERE lang = 'es' UNION ALL SELECT source, 1, doc_id FROM documents WHERE lang = 'de') SELECT source, arg_min(grp, grp * 1000000000 + ord) AS grp, arg_min(ord, grp * 1000000000 + ord) AS ord FROM u GROUP BY 1")
def sources_merge(t):
    g = lambda lang: t("documents").where(F.col("lang") == lang).select("source", F.col("doc_id").alias("ord"))
    return R.merge_groups(g("es"), g("de"), key="source")


@query("hybrid_outcome", "WITH w AS (SELECT conv_id AS query_id, conv_id % 7 = 0 AS wf, count(*) % 3 AS wn FROM conversations GROUP BY 1), k AS (SELECT conv_id AS query_id, conv_id % 5 = 0 AS kf, count(*) FILTER (WHERE role = 'user') % 2 AS kn FROM conversations WHERE conv_id % 11 <> 0 GROUP BY 1) SELECT query_id, CASE WHEN wf THEN 'web_failed' WHEN wn = 0 THEN 'no_answer' WHEN coalesce(kf, true) OR kn = 0 THEN 'web_only' ELSE 'both' END AS outcome FROM w LEFT JOIN k USING (query_id)")
def hybrid_outcome(t):
    c = t("conversations")
    q = F.col("conv_id").alias("query_id")
    w = c.groupBy(q).agg((F.count("*") % 3).alias("n")).withColumn("failed", F.col("query_id") % 7 == 0)
    k = c.where("conv_id % 11 <> 0").groupBy(q).agg((F.count_if(F.col("role") == "user") % 2).alias("n")).withColumn("failed", F.col("query_id") % 5 == 0)
    return R.hybrid(k, w)


@query("session_history", "SELECT session_id, count(*) AS turns, array_to_string(list(role || ':' || length(content) ORDER BY turn), ' ') AS history FROM messages GROUP BY 1")
def session_history(t):
    item = F.concat_ws(":", "role", F.char_length("content"))
    return ST.session_history(t.messages(), item).withColumn("history", F.array_join("history", " "))


@query("citations_by_message", "SELECT m.message_id, count(*) AS n, array_to_string(list(s.source_id ORDER BY s.source_id), ',') AS sources FROM messages m JOIN kb_sources s ON s.active AND (m.session_id + m.turn) % 20 = CAST(replace(s.source_id, 'src', '') AS BIGINT) WHERE m.role = 'assistant' GROUP BY 1")
def citations_by_message(t):
    s = t.kb_sources().where("active").select("source_id", F.replace("source_id", F.lit("src"), F.lit("")).cast("long").alias("k"))
    m = t.messages().where("role = 'assistant'").withColumn("k", (F.col("session_id") + F.col("turn")) % 20)
    return ST.citations(m, s, "k").withColumn("sources", F.array_join("sources", ","))


@query("source_visible", "SELECT u.user_id, count(*) AS visible FROM users u JOIN kb_sources s ON u.user_id % 20 = CAST(replace(s.source_id, 'src', '') AS BIGINT) WHERE s.active GROUP BY 1")
def source_visible(t):
    s = t.kb_sources().where("active").select(F.replace("source_id", F.lit("src"), F.lit("")).cast("long").alias("school"))
    return ST.visible(t.users().withColumn("school", F.col("user_id") % 20), s, "school")


@query("owned_insert", "SELECT message_id FROM messages WHERE session_id IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0)")
def owned_insert(t):
    own = t("conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("session_id"))
    return ST.owned(t.messages(), own, "session_id").select("message_id")


@query("upsert_sources", "WITH o AS (SELECT c_custkey AS id, c_nationkey AS school, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS school, 'new ' || c_name AS name FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL OR n.school = o.school THEN coalesce(n.name, o.name) ELSE o.name END AS name FROM o FULL JOIN n ON o.id = n.id")
def upsert_sources(t):
    """New rows come in; old ones change only within their school."""
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("school"), F.col("c_name").alias("name"))
    n = c.where("id % 2 = 0").select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("school")).alias("school"), F.concat(F.lit("new "), "name").alias("name"))
    return ST.upsert(c.where("id % 3 <> 0"), n, "id", "school").select("id", "name")


@query("query_terms", r"""WITH q AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM conversations WHERE role = 'user'),
w AS (SELECT *, list_filter(regexp_split_to_array(q, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM q),
e AS (SELECT *, flatten(list_transform(words, lambda x: list_prepend([x, 'word'], CASE WHEN length(x) > 4 THEN list_transform(range(1, length(x)), lambda i: [substr(x, i, 2), 'part']) ELSE [] END))) AS terms FROM w)
SELECT conv_id, turn, array_to_string(list_reduce(list_prepend(CASE WHEN length(q) >= 2 THEN [q] ELSE [] END, terms), lambda acc, t: CASE WHEN length(t[1]) < 2 OR list_contains(acc, t[1]) OR (t[2] = 'part' AND len(acc) >= 12) THEN acc ELSE list_append(acc, t[1]) END), '|') AS terms FROM e""")
def query_terms(t):
    return questions(t).select("conv_id", "turn", F.array_join(R.query_terms(F.col("q")), "|").alias("terms"))


SECT = "sect AS (SELECT doc_id, i AS ord, trim(line) AS text, CAST(((length(lower(line)) - length(replace(lower(line), 'the and', ''))) // 7) * 8 + (length(lower(line)) - length(replace(lower(line), 'the', ''))) // 3 + (length(lower(line)) - length(replace(lower(line), 'and', ''))) // 3 AS BIGINT) AS score FROM (SELECT doc_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents)))"


def sections(t):
    s = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return s.select("doc_id", (F.col("p") + 1).cast("long").alias("ord"), F.btrim("line").alias("text"), R.relevance(F.lower("line"), R.query_terms(F.lit("the and"))).alias("score"))


@query("relevance_score", f"WITH {SECT} SELECT doc_id, ord, score FROM sect")
def relevance_score(t):
    return sections(t).select("doc_id", "ord", "score")


TOPK = f"WITH {SECT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rank FROM sect WHERE length(text) >= 8), l AS (SELECT *, 1200 - coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM k WHERE rank <= 3), s AS (SELECT doc_id, ord, rank, score, left(text, CAST(left_ AS BIGINT)) AS text FROM l WHERE left_ > 0) "


@query("section_topk", TOPK + "SELECT doc_id, ord, rank, score, text FROM s")
def section_topk(t):
    return R.section_topk(sections(t), "doc_id").select("doc_id", "ord", F.col("rank").cast("long").alias("rank"), "score", "text")


@query("web_gather", TOPK + ", g AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY rank) AS excerpt FROM s GROUP BY 1), r AS (SELECT doc_id, source, text AS snippet, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang <> 'es') SELECT r.source, r.doc_id, coalesce(excerpt, snippet) AS excerpt FROM r LEFT JOIN g USING (doc_id) WHERE n <= 3")
def web_gather(t):
    """Allowed results, the first three of each source, their best sections or the snippet."""
    w = Window.partitionBy("source").orderBy("doc_id")
    r = t("documents").where("lang <> 'es'").withColumn("n", F.row_number().over(w)).where("n <= 3").select("source", "doc_id", F.col("text").alias("snippet"))
    s = R.section_topk(sections(t).join(r.select("doc_id"), "doc_id", "left_semi"), "doc_id")
    g = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("excerpt"))
    return r.join(g, "doc_id", "left").select("source", "doc_id", F.coalesce("excerpt", "snippet").alias("excerpt"))


def cites(t):
    e = evid(t)
    d = F.col("doc_id").cast("string")
    return R.citations(e.select("query_id", "ord", "source_id", d.alias("document_id"), "knowledge_id", "chunk_id", F.col("source_name").alias("title"), F.col("content").alias("text"), "attachment_url", "official_url", F.lit("http://localhost/x").alias("parent_url")))


@query("citations_build", EVI + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS index, 'cit_' || left(sha256(source_id || chr(0) || doc_id || chr(0) || knowledge_id || chr(0) || 'c' || doc_id), 24) AS citation_id FROM evi WHERE rank <= 4")
def citations_build(t):
    return cites(t).select("query_id", F.col("index").cast("long").alias("index"), "citation_id")


@query("grounding_text", EVI + "SELECT query_id, string_agg('Evidence ' || rank || ': Office ' || source_id || chr(10) || left(trim(d.text), 1800) || CASE WHEN length(trim(d.text)) > 1800 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS material FROM evi JOIN documents d USING (doc_id) WHERE rank <= 4 GROUP BY 1")
def grounding_text(t):
    e = evid(t).select("query_id", F.col("rank").alias("index"), F.col("source_name").alias("title"), "content")
    return R.grounding(e, "query_id")


@query("cacheable", EVI + ", c AS (SELECT query_id, count(*) AS n, bool_and(contains(source_url, '/f/') OR rank < 4) AS ok FROM evi WHERE rank <= 4 GROUP BY 1) SELECT DISTINCT d.source AS query_id, coalesce(ok, false) AS cacheable FROM documents d LEFT JOIN c ON c.query_id = d.source")
def cacheable(t):
    e = evid(t).select("query_id", F.col("rank").alias("index"), (F.col("source_url").contains("/f/") | (F.col("rank") < 4)).alias("official"), F.col("source_url").alias("url"))
    return R.cacheable(t("documents").select(F.col("source").alias("query_id")).distinct(), e, "query_id")


@query("citable_filter", EVI + "SELECT query_id, count(*) AS n FROM evi WHERE rank <= 4 GROUP BY 1")
def citable_filter(t):
    return cites(t).groupBy("query_id").agg(F.count("*").alias("n"))


#: For the oracle: the parts of these pages. A p ends where the next begins.
PAGE = (
    "WITH pg AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS art, regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS ad FROM pages), "
    "words AS (SELECT *, list_filter(list_transform(string_split_regex(art, '<[^>]*>'), lambda x: trim(x)), lambda x: x <> '') AS art_texts, trim(ad) AS ad_text FROM pg), "
    "main AS (SELECT *, length(plain(array_to_string(art_texts, ' '))) > 200 AS big FROM words) "
)


def _plain(sql: str) -> str:
    """plain(x) in a statement: x with the entities of these pages resolved."""
    while (at := sql.find("plain(")) >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        inner = sql[at + 6 : end]
        sql = sql[:at] + f"regexp_replace(replace(replace(replace({inner}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')" + sql[end + 1 :]
    return sql


_TITLE = "CASE WHEN length(plain(trim(regexp_extract(html, '<h1>([^<]*)', 1)))) >= 6 THEN plain(trim(regexp_extract(html, '<h1>([^<]*)', 1))) WHEN length(plain(trim(regexp_extract(html, '<title>([^<]*)', 1)))) >= 6 THEN plain(trim(regexp_extract(html, '<title>([^<]*)', 1))) ELSE '' END"


def trees(t):
    return D.dom(t("pages")).withColumn("found", D.elements("nodes"))


@query("page_title", _plain(f"SELECT page_id, {_TITLE} AS title FROM pages"))
def page_title(t):
    return trees(t).select("page_id", D.title("nodes", F.col("found")).alias("title"))


def normalized(t):
    """Main text of every page as Markdown, without noise."""
    pages = D.dom(t("pages"), drop=D.NOISE).withColumn("found", D.elements("nodes")).withColumn("box", D.main_container(F.col("found")))
    return pages.select("page_id", "url", D.title("nodes", F.col("found")).alias("title"), D.markdown_walk("nodes", F.col("box")).alias("markdown"))


@query("html_normalize", _plain(PAGE + f"SELECT page_id, {_TITLE} AS title, CASE WHEN big THEN plain(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(art, '<h1>([^<]*)</h1>', chr(10) || chr(10) || '## \\1' || chr(10) || chr(10)), '\\s*</?(?:a|b)(?: [^>]*)?>\\s*', chr(10), 'g'), '\\s*</?(?:p|br|ul|li|div)>\\s*', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) ELSE plain(ad_text) END AS markdown FROM main"))
def html_normalize(t):
    return normalized(t).drop("url")


@query("parse_html", _plain(PAGE + f"SELECT page_id, {_TITLE.replace("ELSE ''", "ELSE url")} AS title, 'html:article' AS parser, 'publication_date_unknown' AS flags, length(c) AS chars, sha256(c) AS content_sha FROM (SELECT page_id, url, html, plain(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(art, '<h1>([^<]*)</h1>', chr(10) || chr(10) || '## \\1' || chr(10) || chr(10)), '<br>', chr(10), 'g'), '</?(?:p|ul|li|div)>', chr(10) || chr(10), 'g'), '</?[a-z]+[^>]*>', '', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS c FROM main)"))
def parse_html(t):
    p = D.article(D.dom(t("pages"), drop=D.NOT_IN_ARTICLES), "page_id", "url", ["pdf", "docx", "xlsx", "zip"], selectors=(*D.ARTICLES, "article"))
    return p.select("page_id", "title", "parser", F.array_join("quality_flags", "|").alias("flags"), F.char_length("clean_content").alias("chars"), F.sha2("clean_content", 256).alias("content_sha"))


@query("visible_blocks", _plain(PAGE + "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, tag, text FROM (SELECT page_id, i, CASE WHEN starts_with(x, '<h1>') THEN 'h1' ELSE 'p' END AS tag, plain(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM (SELECT page_id, unnest(string_split_regex(art, '<p>|</p>|</h1>')) AS x, unnest(range(1, len(string_split_regex(art, '<p>|</p>|</h1>')) + 1)) AS i FROM pg)) WHERE text <> ''"))
def visible_blocks(t):
    blocks = D.visible_blocks("nodes")
    return D.dom(t("pages"), drop=D.NOT_IN_BLOCKS).select("page_id", F.posexplode(blocks).alias("pos", "b")).select("page_id", "pos", "b.tag", "b.text")


@query("main_block", _plain(PAGE + "SELECT page_id, CASE WHEN big THEN 'article' ELSE 'longest' END AS selector, CASE WHEN big THEN plain(array_to_string(art_texts, ' ')) ELSE plain(ad_text) END AS main_block FROM main"))
def main_block(t):
    p = D.dom(t("pages"), drop=D.NOISE).withColumn("box", D.main_container(D.elements("nodes")))
    return p.select("page_id", "box.selector", D.text_of(D.subtree("nodes", F.col("box"))).alias("main_block"))


@query("page_links", _plain("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, regexp_extract(url, '^[a-z]+://[^/?#]*') || plain(regexp_extract(x, 'href=\"([^\"]*)\"', 1)) AS url, title, CAST(NULL AS VARCHAR) AS parent, 'page' AS kind FROM (SELECT page_id, url, x, i, plain(trim(regexp_extract(x, '>([^<]*)<', 1))) AS title FROM (SELECT page_id, url, unnest(h) AS x, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS h FROM pages WHERE page_id % 3 <> 0))) WHERE regexp_matches(title, '[a-m]$|[.,]$') AND NOT regexp_matches(title, '^[A-C]')"))
def page_links(t):
    """Links of listings (two of three pages) and articles, whose main element has none."""
    return D.discovered(D.dom(t("pages")), "page_id", F.pmod("page_id", F.lit(3)) != 0, ["pdf", "docx", "xlsx", "zip"], ["[a-m]$", "[.,]$"], "^[A-C]")


@query("link_resolve", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), '[^/]+/$', '') || 'a?b=1#c' AS link FROM pages")
def link_resolve(t):
    return t("pages").select("page_id", U.resolved("url", F.lit("../a?b=1#c")).alias("link"))


@query("decode_pages", "SELECT page_id, sha256(html) AS sha, 'utf-8' AS encoding FROM pages")
def decode_pages(t):
    raw = t("pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return H.decode_pages(raw, "content", F.lit("text/html"), "page_id").select("page_id", F.sha2("text", 256).alias("sha"), "encoding")


@query("publish_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders")
def publish_date(t):
    """The first date after a hint; days that aren't in the calendar count as none."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Posted by x. Published: "), F.when(k % 5 == 0, "2024-02-31").otherwise(F.date_format("o_orderdate", "yyyy-M-d")), F.lit(" views 12"))
    return t("orders").select(k, D.after_hint(text, ["Updated:", "Published:"], r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})").alias("published"))


SUBJECT = "[aeiou]{2}"


@query("title_evidence", rf"""WITH d AS (SELECT doc_id, source, text, CASE WHEN doc_id % 5 = 0 THEN 'Welcome ' || lang WHEN doc_id % 5 = 1 THEN 'About ' || source ELSE '' END AS raw FROM documents),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '')[1:8] AS c FROM d),
k AS (SELECT doc_id, source, raw, list_transform(c, lambda x: regexp_replace(x, '^#+\s*', '')) AS c FROM l),
j AS (SELECT doc_id, i, c[i] AS x, CASE WHEN i > 1 AND length(c[i - 1]) < 12 AND NOT regexp_matches(c[i - 1], '\d') THEN c[i - 1] || c[i] ELSE c[i] END AS y FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM k)),
h AS (SELECT doc_id, arg_min(y, i) AS heading FROM j WHERE NOT (starts_with(x, '|') OR starts_with(x, 'Lic')) AND length(y) BETWEEN 8 AND 140 AND regexp_matches(y, '{SUBJECT}') GROUP BY 1)
SELECT doc_id, CASE WHEN raw <> '' AND NOT regexp_matches(raw, '^Welcome') THEN raw WHEN doc_id % 2 = 0 AND heading IS NOT NULL THEN heading ELSE trim(source) END AS title, CASE WHEN raw <> '' AND NOT regexp_matches(raw, '^Welcome') THEN 'raw_html_heading' WHEN doc_id % 2 = 0 AND heading IS NOT NULL THEN 'attachment_first_heading' ELSE 'legacy_title' END AS source FROM k LEFT JOIN h USING (doc_id)""")
def title_evidence(t):
    """Titles by what tells of them; every second document is an attachment."""
    k = F.col("doc_id")
    raw = F.when(k % 5 == 0, F.concat(F.lit("Welcome "), "lang")).when(k % 5 == 1, F.concat(F.lit("About "), "source")).otherwise("")
    found = X.evidence_title(raw, "^Welcome", k % 2 == 0, X.first_heading("text", SUBJECT, ["|", "Lic"]), F.concat("source", F.lit("- The site")), "[-—] The site[^\n]*$")
    return t("documents").select("doc_id", found.alias("f")).select("doc_id", "f.title", "f.source")


MENTION = r"\d{4}-\d{2}-\d{2}|[Vv]ersion \d+(?:\.\d+)?|[A-Za-z]+\.com"


@query("date_mentions", rf"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS x FROM documents), m AS (SELECT doc_id, x, regexp_extract_all(x, '{MENTION}') AS h, list_transform(regexp_extract_all(x, '{MENTION}'), lambda y: length(y)) AS hl, list_transform(regexp_split_to_array(x, '{MENTION}'), lambda y: length(y)) AS gl FROM c), p AS (SELECT doc_id, x, i, h[i] AS text, list_sum(gl[1:i]) + coalesce(list_sum(hl[1:i - 1]), 0) AS s, hl[i] AS n FROM (SELECT *, unnest(range(1, least(len(h), 40) + 1)) AS i FROM m)) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, text, substr(x, CAST(greatest(s - 45, 0) + 1 AS BIGINT), CAST(s + n + 65 - greatest(s - 45, 0) AS BIGINT)) AS context FROM p")
def date_mentions(t):
    """Dates, versions and hosts with the text around them; contexts overlap where mentions
    stand close together."""
    found = X.mentions(X.canonical_text("text"), MENTION)
    return t("documents").select("doc_id", F.posexplode(found).alias("pos", "m")).select("doc_id", "pos", "m.text", "m.context")


@query("zip_members", "SELECT 'a' || page_id || '.zip' AS path, member, size, CASE page_id % 50 WHEN 7 THEN 'File is not a zip file' WHEN 3 THEN 'unsafe_path' END AS error FROM (SELECT page_id, unnest(CASE WHEN page_id % 50 IN (3, 7) THEN [struct_pack(m := NULL::VARCHAR, s := NULL::BIGINT)] ELSE [struct_pack(m := 'p' || page_id || '.html', s := CAST(strlen(html) AS BIGINT)), struct_pack(m := 'b.txt', s := 1::BIGINT)] END, recursive := true) FROM pages) t(page_id, member, size)")
def zip_members(t):
    """Members of archives made of pages; one archive is broken."""
    import io
    import zipfile

    import pyarrow as pa

    def pack(stream):
        for b in stream:
            out = []
            for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w") as z:
                    z.writestr(f"p{i}.html", h)
                    z.writestr("../up" if i % 50 == 3 else "b.txt", "x")
                out.append((f"a{i}.zip", f.getvalue() if i % 50 != 7 else b"broken"))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["path", "content"])

    files = t("pages").select("page_id", "html").mapInArrow(pack, "path string, content binary")
    return scan_zip(files).select("path", "member", "size", "error")


@query("span_expand", "SELECT n_nationkey, y, CASE y WHEN 0 THEN n_name || '|wide|wide' ELSE n_name || '|' || n_nationkey || '|z' END AS row FROM (SELECT n_nationkey, n_name, unnest([0, 1]) AS y FROM nation)")
def span_expand(t):
    """Dense grids of tables with spans, one table per nation."""
    cell = lambda a, *x: F.concat(F.lit(f"<td {a}>"), *x, F.lit("</td>"))
    html = F.concat(F.lit("<table><tr>"), cell("rowspan=2", "n_name"), cell("colspan=2", F.lit("wide")), F.lit("</tr><tr>"), cell("", F.col("n_nationkey").cast("string")), cell("", F.lit("z")), F.lit("</tr></table>"))
    p = D.dom(t("nation").select("n_nationkey", F.lit("").alias("url"), html.alias("html")), key="n_nationkey")
    table = F.get(F.filter("nodes", lambda n: n.tag == "table"), 0).text
    lines = F.transform(F.split(table, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\| | \|$", ""), r" \| ", "|"))
    return p.select("n_nationkey", F.posexplode(F.concat(F.slice(lines, 1, 1), F.slice(lines, 3, 100))).alias("y", "row"))


@query("candidates", _plain(f"WITH p AS (SELECT page_id AS doc_id, url, {_TITLE} AS title FROM pages) SELECT p.doc_id, p.url, CASE WHEN p.title <> '' THEN p.title ELSE coalesce(u.title, '') END AS title, r.parent_id IS NOT NULL AS attachment FROM p LEFT JOIN relations r ON r.child_id = p.doc_id LEFT JOIN p u ON u.doc_id = r.parent_id"))
def candidates_assembly(t):
    """Frontier joined with what was fetched; attachments inherit a title from their parent."""
    p = settle(trees(t).select(F.col("page_id").alias("doc_id"), "url", D.title("nodes", F.col("found")).alias("title")))
    rel = t.relations().select(F.col("child_id").alias("doc_id"), "parent_id")
    up = p.select(F.col("doc_id").alias("parent_id"), F.col("title").alias("parent_title"))
    d = p.join(rel, "doc_id", "left").join(up, "parent_id", "left")
    return d.select("doc_id", "url", X.first_present("title", F.coalesce("parent_title", F.lit(""))).alias("title"), F.col("parent_id").isNotNull().alias("attachment"))
