"""Queries over texts: tidying, extraction, hashing, deduplication, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import dedup as D
from ..operators.search import contains_join
from ..sources import sinks as SK
from ..sources import versioned as V
from ..sources.tables import checkpoint_folder
from .registry import query

WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
CANON = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


@query("text_canonical", f"SELECT doc_id, sha256({CANON}) AS canonical_sha, CAST(length(regexp_replace(text, '{WS}', '', 'g')) AS BIGINT) AS compact_chars FROM documents")
def text_canonical(t):
    return t("documents").select("doc_id", F.sha2(X.canonical_text("text"), 256).alias("canonical_sha"), F.char_length(X.compact("text")).cast("long").alias("compact_chars"))


@query("text_tidy", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{3000}\x{A0}]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')) AS tidy_sha FROM documents")
def text_tidy(t):
    return t("documents").select("doc_id", F.sha2(X.tidy("text"), 256).alias("tidy_sha"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 280 THEN left(text, 280) || '…' ELSE text END AS summary FROM documents")
def truncate_text(t):
    return t("documents").select("doc_id", X.truncated("text", 280).alias("summary"))


@query("first_present", r"SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '\?(.*)$', 1)), ''), nullif(trim(regexp_extract(url, '#(.*)$', 1)), ''), nullif(trim('  '), ''), trim(url), '') AS shown FROM pages")
def first_present(t):
    u = F.col("url")
    return t("pages").select("page_id", X.first_present(F.regexp_extract(u, r"\?(.*)$", 1), F.regexp_extract(u, "#(.*)$", 1), F.lit("  "), u).alias("shown"))


@query("token_estimate", "SELECT conv_id, CAST(sum(floor((length(text) + 2) / 3.0) + 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def token_estimate(t):
    return t("conversations").groupBy("conv_id").agg(F.sum(X.token_estimate("text") + 4).alias("tokens"))


@query("doc_emails", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))[1:5], ',') AS emails, CAST(len(regexp_extract_all(text, '\d{3}-\d{4}')) AS INTEGER) AS phones FROM documents")
def doc_emails(t):
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return t("documents").select("doc_id", F.array_join(X.distinct_sorted(found, 5), ",").alias("emails"), F.size(F.regexp_extract_all("text", F.lit(r"\d{3}-\d{4}"), F.lit(0))).alias("phones"))


@query("title_normalize", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '^(The|De|La|Die) ', ''), ' (of|que|der) .*$', ''), '[.*%$&#]+$', '')) AS title FROM pages")
def title_normalize(t):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return t("pages").select("page_id", X.normalized_title(title, "(?:The|De|La|Die) ", " (?:of|que|der) ", r"[.*%$&#]+$").alias("title"))


@query("version_group", "SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS academic_year, CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 2 END AS semester, left(sha256(o_orderpriority || chr(0) || strftime(o_orderdate, '%Y')), 24) AS version_group FROM orders")
def version_group(t):
    d = F.col("o_orderdate")
    y = F.date_format(d, "yyyy")
    return t("orders").select("o_orderkey", F.concat(y, F.lit("-"), (F.year(d) + 1).cast("string")).alias("academic_year"), F.when(F.month(d) < 7, 1).otherwise(2).alias("semester"), X.scoped_id("", "o_orderpriority", y).alias("version_group"))


@query("version_family", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[Vv]ersion (\d+(?:\.\d+)?)', 1))), ',') AS labels, left(sha256(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '\d+(\.\d+)*', '{v}', 'g')), 24) AS family FROM documents")
def version_family(t):
    labels = X.distinct_sorted(F.regexp_extract_all("text", F.lit(r"[Vv]ersion (\d+(?:\.\d+)?)"), F.lit(1)))
    return t("documents").select("doc_id", F.array_join(labels, ",").alias("labels"), X.scoped_id("", F.regexp_replace(F.regexp_extract("text", r"^([^\n]*)", 1), r"\d+(\.\d+)*", "{v}")).alias("family"))


@query("evidence_window", f"WITH b AS (SELECT item_id, regexp_replace(text, '{WS}', '', 'g') AS n FROM benchmark), d AS (SELECT doc_id, {CANON} AS c, regexp_replace(text, '{WS}', '', 'g') AS k FROM documents), w AS (SELECT item_id, doc_id, c, length(n) AS l, instr(k, n) AS q, string_split(c, '') AS s FROM b JOIN d ON contains(k, n)), p AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: s[i] <> ' ') AS places FROM w), a AS (SELECT *, greatest(places[q] - 100, 1) AS b FROM p) SELECT item_id, doc_id, substr(c, b, places[q + l - 1] + 101 - b) AS evidence FROM a")
def evidence_window(t):
    """Passages are looked up without white space, as the window ignores it."""
    b = t("benchmark").select("item_id", X.compact("text").alias("needle"))
    d = t("documents").select("doc_id", X.compact("text").alias("body"), "text")
    j = contains_join(d, b, "doc_id", "body", "needle")
    return j.select("item_id", "doc_id", X.evidence_window("text", "needle").alias("evidence"))


@query("quote_span", f"SELECT doc_id, regexp_extract({CANON}, 't ?h ?e.*?o ?f') AS quote FROM documents WHERE regexp_matches({CANON}, 't ?h ?e.*?o ?f')")
def quote_span(t):
    q = X.quote_span("text", F.lit("the"), F.lit("o f")).alias("quote")
    return t("documents").select("doc_id", q).where("quote IS NOT NULL")


@query("artifact_normalize", r"WITH a AS (SELECT page_id, page_id % 3 = 0 AS attachment, '# ' || url || chr(13) || chr(10) || html AS x, url FROM pages), b AS (SELECT page_id, replace(replace(CASE WHEN attachment THEN x ELSE '# Title of ' || page_id || chr(10) || substr(x, length('# ' || url || chr(13) || chr(10)) + 1) END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS y FROM a) SELECT page_id, sha256(trim(regexp_replace(y, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(32) || chr(9))) AS sha FROM b")
def artifact_normalize(t):
    x = F.concat(F.lit("# "), "url", F.lit("\r\n"), "html")
    title = F.concat(F.lit("Title of "), F.col("page_id").cast("string"))
    return t("pages").select("page_id", F.sha2(X.normalized_artifact(x, title, F.pmod("page_id", F.lit(3)) == 0), 256).alias("sha"))


@query("date_label", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'unknown' WHEN CAST(o_orderdate AS DATE) = DATE '1998-03-05' THEN 'today' WHEN CAST(o_orderdate AS DATE) = DATE '1998-03-04' THEN 'yesterday' ELSE month(o_orderdate) || '-' || day(o_orderdate) END AS label FROM orders")
def date_label(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", X.date_label(d, F.lit("1998-03-05").cast("date"), d < F.lit("1995-06-01").cast("timestamp_ntz")).alias("label"))


@query("parse_dates", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events")
def parse_dates(t):
    k = F.pmod("event_id", F.lit(4))
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy/MM/dd")).when(k == 2, F.date_format("ts", " yyyy-MM-dd HH:mm:ss ")).otherwise("soon")
    parsed = X.parse_time(raw, ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd"])
    # the zoned form is rendered in UTC, so the day doesn't hang on the session's zone
    day = F.when(k == 0, F.substring(raw, 1, 10)).otherwise(F.date_format(parsed, "yyyy-MM-dd"))
    return t("events").select("event_id", day.alias("day"))


@query("parse_units", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 86400 ELSE NULL END AS seconds, CASE p_size % 2 WHEN 0 THEN CAST(p_size AS BIGINT) * 1048576 ELSE CAST(p_size * 1.5 * 1024 AS BIGINT) END AS bytes FROM part")
def parse_units(t):
    n = F.col("p_size").cast("string")
    dur = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit("m"))).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" d"))).otherwise(F.concat(n, F.lit("parsec")))
    size = F.when(F.col("p_size") % 2 == 0, F.concat(n, F.lit("MB"))).otherwise(F.concat((F.col("p_size") * 1.5).cast("decimal(10,1)").cast("string"), F.lit("kb")))
    return t("part").select("p_partkey", X.parse_units(dur, X.DURATIONS).alias("seconds"), X.parse_units(size, X.SIZES).alias("bytes"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("source_ids", "SELECT doc_id, 'src_kb_' || left(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 24) AS kb_id, 'cit_' || left(sha256(source || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || lang), 24) AS cit_id FROM documents")
def source_ids(t):
    d = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", X.scoped_id("src_kb_", "source", d).alias("kb_id"), X.scoped_id("cit_", "source", d, "lang").alias("cit_id"))


@query("cache_keys", "SELECT conv_id, turn, 'query:' || CASE WHEN regexp_matches(role, '^[a-z0-9_-]+$') THEN role ELSE left(sha256(role), 16) END || ':' || left(sha256('v1' || chr(0) || lower(trim(regexp_replace(text, '" + WS + "', ' ', 'g'))) || chr(0) || '4'), 32) AS key FROM conversations")
def cache_keys(t):
    seg = F.when(F.col("role").rlike("^[a-z0-9_-]+$"), F.col("role")).otherwise(F.substring(F.sha2("role", 256), 1, 16))
    material = F.concat_ws("\0", F.lit("v1"), F.lower(X.canonical_text("text")), F.lit("4"))
    return t("conversations").select("conv_id", "turn", F.concat(F.lit("query:"), seg, F.lit(":"), F.substring(F.sha2(material, 256), 1, 32)).alias("key"))


@query("cache_lookup", "WITH c AS (SELECT sha256(text) AS key, max(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE) AS expires_at, arg_max(turn, turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT q.conv_id, q.turn, coalesce(c.expires_at > TIMESTAMP '2024-01-01 00:02:00' AND c.turn % 5 <> 0, false) AS hit FROM conversations q LEFT JOIN c ON c.key = sha256(q.text)")
def cache_lookup(t):
    """Answers whose entry hasn't expired and still holds (every fifth turn doesn't); what is
    missing, expired or doesn't hold is a miss."""
    q = t("conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int), 0)")
    entries = q.where("role = 'assistant'").select(F.sha2("text", 256).alias("key"), at.alias("expires_at"), F.col("turn").alias("answer"))
    now = F.lit("2024-01-01 00:02:00").cast("timestamp_ntz")
    return D.cached(q.withColumn("key", F.sha2("text", 256)), entries, "key", now, F.col("entry.answer") % 5 != 0).select("conv_id", "turn", "hit")


@query("tree_digest", "WITH l AS (SELECT source, doc_id // 4096 AS part, doc_id, doc_id || ':' || sha256(text) AS line FROM documents), p AS (SELECT source, part, sha256(string_agg(line, chr(10) ORDER BY doc_id)) AS digest, count(*) AS files FROM l GROUP BY 1, 2) SELECT source, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS digest FROM p GROUP BY 1")
def tree_digest(t):
    return X.tree_digest(t("documents"), "source", "doc_id", "text").select("source", "digest")


@query("name_color", "SELECT p_partkey, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS HUGEINT))), lambda a, b: (a * 31 + b) % 4294967296) AS BIGINT) % 5 AS colour FROM part")
def name_color(t):
    return t("part").select("p_partkey", F.pmod(X.polynomial_hash("p_name"), F.lit(5)).alias("colour"))


@query("text_blocks", "SELECT doc_id, i AS pos, block FROM (SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS block FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: x <> '') AS b FROM documents))")
def text_blocks(t):
    return t("documents").select("doc_id", F.posexplode(X.plain_blocks("text")).alias("p", "block")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "block")


@query("answer_chunks", "WITH p AS (SELECT conv_id, turn, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS c FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS BIGINT) AS pos, chunk FROM (SELECT conv_id, turn, i, c[i] || CASE WHEN i = len(c) THEN '' ELSE chr(10) || chr(10) END AS chunk FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM p)) WHERE chunk <> ''")
def answer_chunks(t):
    """Paragraphs of answers, a sentence each."""
    p = t("conversations").where("role = 'assistant'")
    e = p.select("conv_id", "turn", F.posexplode(X.chunks(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")))).alias("p", "chunk"))
    return e.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "chunk")


@query("md_blocks", rf"""WITH m AS (SELECT doc_id, '## ' || source || chr(10) || chr(10) || regexp_replace(regexp_replace(text, chr(10) || '([A-L])', chr(10) || '- \1', 'g'), chr(10) || '([M-Z])', chr(10) || '12) \1', 'g') AS x FROM documents),
l AS (SELECT doc_id, i, regexp_replace(line, '^{WS}|{WS}$', '', 'g') AS s FROM (SELECT doc_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS line FROM (SELECT doc_id, string_split(x, chr(10)) AS c FROM m))),
k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '(?s)^#{{1,3}}\s+.') THEN 'heading' WHEN regexp_matches(s, '(?s)^[-*]\s+.') THEN 'bullet' WHEN regexp_matches(s, '(?s)^\d+[.)]\s+.') THEN 'numbered' ELSE 'paragraph' END AS kind FROM l),
v AS (SELECT *, CASE kind WHEN 'heading' THEN regexp_replace(s, '^#+\s+', '') WHEN 'bullet' THEN regexp_replace(s, '^[-*]\s+', '') WHEN 'numbered' THEN regexp_replace(s, '^\d+[.)]\s+', '') ELSE s END AS y FROM k),
g AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM v),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM g)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block) AS pos, kind, level, n, content FROM (SELECT doc_id, block, kind, CAST(max(CASE WHEN kind = 'heading' THEN length(regexp_extract(s, '^#+')) END) AS INTEGER) AS level, CAST(CASE WHEN kind = 'paragraph' THEN 1 ELSE count(*) END AS BIGINT) AS n, CASE WHEN kind = 'paragraph' THEN string_agg(y, ' ' ORDER BY i) ELSE string_agg(y, chr(10) ORDER BY i) END AS content FROM h WHERE kind <> 'blank' GROUP BY 1, 2, 3)""")
def md_blocks(t):
    """Documents with marks before some of their lines, as blocks."""
    marked = F.regexp_replace(F.regexp_replace("text", "\n([A-L])", "\n- $1"), "\n([M-Z])", "\n12) $1")
    b = t("documents").select("doc_id", F.posexplode(X.md_blocks(F.concat(F.lit("## "), "source", F.lit("\n\n"), marked))).alias("p", "b"))
    return b.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("b.type").alias("kind"), "b.level", F.size("b.items").cast("long").alias("n"), F.array_join("b.items", "\n").alias("content"))


@query("table_pad", "WITH r AS (SELECT doc_id, i, string_split(line, ' | ') AS cells FROM (SELECT doc_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents)) WHERE contains(line, ' | ')), w AS (SELECT doc_id, max(len(cells)) AS w, min(i) AS top FROM r GROUP BY 1) SELECT doc_id, string_agg('| ' || array_to_string(list_transform(list_resize(cells, w, ''), lambda x: replace(trim(x), '|', chr(92) || '|')), ' | ') || ' |' || CASE WHEN i = top THEN chr(10) || '| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY i) AS md FROM r JOIN w USING (doc_id) GROUP BY 1")
def table_pad(t):
    """The lines with bars of a document as a table."""
    rows = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | "))), lambda x: F.split(x, r" \| "))
    return t("documents").select("doc_id", rows.alias("rows")).where(F.size("rows") > 0).select("doc_id", X.markdown_table(F.col("rows")).alias("md"))


@query("dedup_url_latest", "SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1) ORDER BY page_id % 7 DESC, page_id DESC) = 1 AS kept FROM pages")
def dedup_url_latest(t):
    p = t("pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"))
    return D.latest(p, "host", [F.desc(F.pmod("page_id", F.lit(7))), F.desc("page_id")], salt=8).select("page_id", "kept")


@query("dedup_content", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, lang DESC, doc_id DESC) = 1 AS kept FROM documents")
def dedup_content(t):
    d = t("documents").select("doc_id", "n_chars", "lang", F.sha2("text", 256).alias("content_hash"))
    return D.latest(d, "content_hash", [F.desc("n_chars"), F.desc("lang"), F.desc("doc_id")], salt=8).select("doc_id", "kept")


@query("dedup_prefer", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY review_status = 'ACCEPTED' DESC, pii_detected DESC, n_chars > 1000 DESC, n_chars DESC, doc_id % 4 <> 1 DESC, doc_id DESC) = 1 AS kept FROM kb_documents")
def dedup_prefer(t):
    d = t.kb_documents().withColumn("h", F.sha2("text", 256)).drop("text")
    by = [F.desc(F.col("review_status") == "ACCEPTED"), F.desc("pii_detected"), F.desc(F.col("n_chars") > 1000), F.desc("n_chars"), F.desc(F.pmod("doc_id", F.lit(4)) != 1), F.desc("doc_id")]
    return D.latest(d, "h", by, salt=8).select("doc_id", "kept")


@query("source_merge", "SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS primary_id, array_to_string(list_sort(list_distinct(list(page_id))), ',') AS ids, count(DISTINCT page_id) - 1 AS n_aliases FROM pages GROUP BY 1")
def source_merge(t):
    p = t("pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id")
    return D.merge_sources(p, "url", "page_id", "page_id").select("url", "primary_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.col("n_aliases").cast("long").alias("n_aliases"))


@query("source_remap", "SELECT conv_id, array_to_string(list_transform(list_sort(list(struct_pack(p := p, s := s))), lambda x: x.s), ',') AS ids FROM (SELECT conv_id, 's' || (turn % 3) AS s, min(turn) AS p FROM conversations GROUP BY 1, 2) GROUP BY 1")
def source_remap(t):
    c = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn"))), lambda x: F.concat(F.lit("a"), x["turn"].cast("string"))).alias("ids"))
    al = t("conversations").select(F.concat(F.lit("a"), F.col("turn").cast("string")).alias("alias"), F.concat(F.lit("s"), F.pmod("turn", F.lit(3)).cast("string")).alias("primary_id")).distinct()
    return D.remap(c, "ids", "conv_id", al).select("conv_id", F.array_join("ids", ",").alias("ids"))


@query("dup_report", "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_report(t):
    return D.duplicates(t("documents").select(F.sha2("text", 256).alias("content_hash")), "content_hash")


@query("results_distinct", "SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS ord FROM pages WHERE contains(url, '.example.com') OR contains(url, '.example.org') GROUP BY 1")
def results_distinct(t):
    p = t("pages").where(F.col("url").contains(".example.com") | F.col("url").contains(".example.org")).select(F.regexp_replace("url", "[?#].*$", "").alias("url"), F.col("page_id").alias("ord"))
    return D.first_by_ord(p, "url", "ord")


@query("course_dedup", "SELECT p_brand, p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3")
def course_dedup(t):
    return D.by_signature(t("part"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("frontier_merge", "WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title, CAST(page_id // 10 AS VARCHAR) AS parent FROM pages) SELECT url, coalesce(arg_min(title, page_id) FILTER (WHERE title <> ''), '') AS title, array_to_string(list_sort(list(DISTINCT parent)), ',') AS parents FROM p GROUP BY 1")
def frontier_merge(t):
    title = F.when(F.pmod("page_id", F.lit(3)) == 0, "").otherwise(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    p = t("pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id", title.alias("title"), F.floor(F.col("page_id") / 10).cast("string").alias("parent"))
    return D.merge_frontier(p, "url", "title", "parent", "page_id").withColumn("parents", F.array_join("parents", ","))


@query("crawl_pending", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id < 100)")
def crawl_pending(t):
    p = t("pages").select("url", "page_id")
    return D.pending(p.select("url").distinct(), p.where("page_id < 100"), "url")


@query("import_actions", "WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'changed' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 <> 0) SELECT o.doc_id, CASE WHEN n.doc_id IS NULL THEN 'upload' WHEN n.h = o.h THEN 'reuse' ELSE 'conflict' END AS action FROM o LEFT JOIN n USING (doc_id)")
def import_actions(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    there = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "changed").otherwise(F.col("h")).alias("h"))
    return SK.import_actions(d, there, "doc_id", "h").select("doc_id", "action")


@query("import_documents", "SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN 'upload' ELSE 'reuse' END AS action, sha256(text) AS digest FROM documents")
def import_documents(t):
    """Two imports into a new store: the second finds two thirds of its documents there."""
    d = t("documents").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("digest"), F.col("text").alias("item"))
    store = f"{checkpoint_folder(t.spark)}/stores/{uuid.uuid4().hex}"
    SK.import_documents(d.where("cast(key as long) % 3 <> 0"), store, "first")
    acted = SK.import_documents(d, store, "second")
    return acted.join(SK.documents(t.spark, store).select("key", "digest"), "key").select("key", "action", "digest")


@query("catalog_upsert", "WITH o AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), w AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' AND source <> 'src1' GROUP BY 1) SELECT coalesce(w.source, o.source) AS source, coalesce(w.n, o.n) AS n, CASE WHEN o.source IS NULL THEN 'insert' WHEN w.source IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN w ON o.source = w.source")
def catalog_upsert(t):
    """New rows replace old ones of the same key in the next version of a table; both versions
    tell what happened."""
    g = lambda lang: t("documents").where(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias("n"))
    at = f"{checkpoint_folder(t.spark)}/tables/{uuid.uuid4().hex}"
    new = g("de").where("source <> 'src1'")
    first = V.create(g("en"), at, ["source"], buckets=4)
    second = V.upsert(new, at, based_on=first)
    was = V.read(t.spark, at, first).select("source", F.lit(True).alias("_was"))
    now = V.read(t.spark, at, second).join(was, "source", "left").join(new.select("source", F.lit(True).alias("_new")), "source", "left")
    return now.select("source", "n", F.when(F.col("_was").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("update").alias("action"))


@query("raw_landing", "SELECT page_id, url, sha256(html) || CASE WHEN regexp_extract(lower(regexp_extract(url, '^[^?#]*')), '\\.[a-z0-9]+$') = '.pdf' THEN '.pdf' ELSE '.html' END AS raw_file, CAST(strlen(html) AS BIGINT) AS size FROM (SELECT DISTINCT ON (url) * FROM pages ORDER BY url, page_id)")
def raw_landing(t):
    """Pages landed by content in two goes; the second adds what the first left."""
    base = f"{checkpoint_folder(t.spark)}/landed/{uuid.uuid4().hex}"
    once = t("pages").groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p"))
    fetched = once.select("url", F.encode("p.html", "UTF-8").alias("content"), "p.page_id")
    SK.land(fetched.where("page_id % 2 = 0"), f"{base}/raw", f"{base}/ledger", (".pdf",))
    SK.land(fetched, f"{base}/raw", f"{base}/ledger", (".pdf",))
    return t.spark.read.schema("page_id long, url string, raw_file string, size long").parquet(f"{base}/ledger")
