"""Queries over classification, personal data, admission, review and release."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import admission as A
from ..operators import rules as R
from ..operators.search import contains_join
from ..sources.tables import settle
from .registry import query

#: Rules in the languages of the test documents, in place of those of the campus texts.
ROLES = [("RESULT_ANNOUNCEMENT", "worthless|pathetic|idiot|moron|clown"), ("FORM_TEMPLATE", r"\|"), ("NEWS", "!!"), ("POLICY_REGULATION", "[Ll]icen[cs]e"), ("PROCEDURE_GUIDE", "^(The|And)"), ("ANNUAL_NOTICE", r"\d{4}"), ("PROGRAM_PLAN", "%%%|###")]
TOPICS = [("scholarship", "license|andthe|ofthe"), ("exam", "unddie|derund|diemit"), ("library", "leslade|desle|etla"), ("holiday", "delos|quela|lasde"), ("network", "forthe|withthe")]
HEAD = r"regexp_extract(text, '^([^\n]*)', 1)"
#: News that meets this is no news, as applications and examinations are in the campus rules.
EXEMPT = "[Vv]ersion|ofthe"
ROLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(head, '{p}')" + (f" AND NOT regexp_matches(head, '{EXEMPT}')" if n == "NEWS" else "") + f" THEN '{n}'" for n, p in ROLES) + " ELSE 'UNKNOWN' END"
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
HITS = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '(?i){p}') THEN '{n}' END" for n, p in TOPICS) + "], lambda x: x IS NOT NULL)"
BASE = f"WITH b AS (SELECT doc_id, source, lang, text, n_chars, {HEAD} AS h0, regexp_replace({HEAD}, '{WS}', '', 'g') AS head, regexp_replace(left(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1800), '{WS}', '', 'g') AS intro FROM documents), r AS (SELECT *, {ROLE_SQL} AS role FROM b), th AS (SELECT *, {HITS('head')} AS t FROM r), tt AS (SELECT *, CASE WHEN len(t) > 0 OR role IN ('NEWS', 'NON_STUDENT', 'RESULT_ANNOUNCEMENT') THEN t ELSE {HITS('intro')} END AS hits FROM th), c AS (SELECT *, coalesce(hits[1], 'other') AS topic, len(hits) > 1 AS several, CASE WHEN len(t) > 0 THEN 'title' ELSE 'body_intro' END AS origin FROM tt) "


def base(t):
    return t("documents").withColumn("title", F.regexp_extract("text", r"^([^\n]*)", 1))


def with_role(t):
    return base(t).withColumn("role", R.content_role(F.col("title"), ROLES, EXEMPT))


def classified(t):
    return R.topic(with_role(t), "title", "text", "role", TOPICS)


@query("content_role", BASE + "SELECT doc_id, role FROM r")
def content_role(t):
    return with_role(t).select("doc_id", "role")


@query("topic_assign", BASE + "SELECT doc_id, topic, origin, several FROM c")
def topic_assign(t):
    return classified(t).select("doc_id", "topic", "origin", "several")


@query("audience_assign", BASE + "SELECT doc_id, CASE WHEN role = 'NON_STUDENT' THEN 'TEACHER' WHEN topic IN ('holiday') THEN 'UNDERGRADUATE' WHEN contains(text, 'that') AND contains(text, 'from') THEN 'ALL' WHEN contains(text, 'that') THEN 'UNDERGRADUATE' WHEN contains(text, 'from') THEN 'GRADUATE' ELSE 'UNKNOWN' END AS audience FROM c")
def audience_assign(t):
    return classified(t).select("doc_id", R.audience(F.col("topic"), F.col("role"), F.col("text"), "that", "from", ["holiday"]).alias("audience"))


@query("topic_primary", BASE + ", p AS (SELECT c.doc_id, CASE WHEN c.topic = 'other' THEN coalesce(p.topic, 'other') ELSE c.topic END AS topic, c.hits FROM c LEFT JOIN c p ON p.doc_id = CAST(floor(c.doc_id / 10.0) AS BIGINT) AND c.doc_id % 4 = 1) SELECT doc_id, array_to_string(list_prepend(topic, list_filter(hits, lambda x: x <> topic)), ',') AS topics FROM p")
def topic_primary(t):
    """The primary topic (an attachment without one inherits its parent's) before the others."""
    d = settle(R.topic(with_role(t), "title", "text", "role", TOPICS, hits="hits").select("doc_id", "hits", "topic"))
    up = d.select(F.col("doc_id").alias("parent_id"), F.col("topic").alias("parent_topic"))
    rel = t.relations().select(F.col("child_id").alias("doc_id"), "parent_id")
    j = d.join(rel.join(up, "parent_id"), "doc_id", "left")
    topic = F.when(F.col("topic") == "other", F.coalesce("parent_topic", F.lit("other"))).otherwise(F.col("topic"))
    return j.select("doc_id", F.array_join(F.array_union(F.array(topic), "hits"), ",").alias("topics"))


KINDS = {"regulation": "^[A-F]", "guide": "[aeiou]{3}", "calendar": " (?:de|le) ", "form": r"[|]", "result": "!!|idiot"}


@query("doc_type", f"SELECT doc_id, CASE WHEN regexp_matches(head, '{KINDS['result']}') THEN 'result' WHEN regexp_matches(head, '{KINDS['form']}') THEN 'form' WHEN regexp_matches(head, '{KINDS['calendar']}') THEN 'calendar' WHEN regexp_matches(head, '{KINDS['regulation']}') THEN 'regulation' WHEN regexp_matches(head, '{KINDS['guide']}') THEN 'guide' WHEN doc_id % 4 = 1 THEN 'attachment' ELSE 'notice' END AS document_type FROM (SELECT doc_id, left({HEAD}, 60) AS head FROM documents)")
def doc_type(t):
    """Kinds of documents by the beginning of their first line; every fourth is an attachment."""
    head = F.substring(F.regexp_extract("text", "^([^\n]*)", 1), 1, 60)
    return t("documents").select("doc_id", R.document_type(head, KINDS, F.pmod("doc_id", F.lit(4)) == 1).alias("document_type"))


@query("source_meta", """WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, split_part(lower(regexp_extract(url, '//([^/:?#]*)', 1)), '.', 1) AS label FROM pages),
n AS (SELECT label, CASE WHEN length(label) % 2 = 0 THEN 'College ' ELSE 'Office ' END || label AS name, CASE WHEN length(label) % 2 = 0 THEN 'college' ELSE 'department' END AS kind FROM (SELECT DISTINCT label FROM p WHERE length(label) <> 7 AND label <> 'blog')),
d AS (SELECT p.*, n.name, coalesce(n.kind = 'college', false) AS college_, label = 'blog' AS portal, CASE WHEN contains(url, '/en/') THEN 'English desk' WHEN contains(url, '/de/') THEN 'German desk' ELSE nullif(regexp_extract(title, '^([A-M][a-z]+) ', 1), '') END AS desk FROM p LEFT JOIN n USING (label))
SELECT page_id, CASE WHEN NOT college_ AND portal THEN 'The portal' ELSE name END AS source_name, CASE WHEN college_ THEN name WHEN portal THEN desk ELSE name END AS department, CASE WHEN college_ THEN name END AS college,
CASE WHEN college_ THEN 'college' WHEN portal THEN CASE WHEN desk = 'English desk' THEN 'school' END WHEN name IS NOT NULL THEN 'school' END AS scope, CASE WHEN college_ THEN 'OFFICIAL_COLLEGE' WHEN NOT portal AND label = 'www' THEN 'OFFICIAL_SCHOOL' ELSE 'OFFICIAL_DEPARTMENT' END AS authority FROM d""")
def source_meta(t):
    """Who publishes a page. Names of hosts are made of their first labels; some have none."""
    p = t("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    label, even = F.col("label"), F.char_length("label") % 2 == 0
    known = p.select(F.split_part(F.lower(F.regexp_extract("url", "//([^/:?#]*)", 1)), F.lit("."), F.lit(1)).alias("label")).where("length(label) <> 7 AND label <> 'blog'").distinct()
    names = known.select("label", F.concat(F.when(even, "College ").otherwise("Office "), label).alias("name"), F.when(even, "college").otherwise("department").alias("kind"))
    found = R.source_metadata(p, "url", "title", names, "blog", "The portal", [("/en/", "English desk"), ("/de/", "German desk")], ["English desk"], ["www"], "^([A-M][a-z]+) ")
    return found.drop("url", "title")


FLAGS = [("contains_url", "https?://"), ("long_token", r"[^\s]{30}"), ("shouting", "!!"), ("table_layout", r" \| "), ("unicode_corruption", "�")]


@query("quality_flags", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FLAGS) + ", CASE WHEN n_chars < 120 THEN 'too_short' END], lambda x: x IS NOT NULL)), ',') AS flags FROM documents")
def quality_flags(t):
    rules = [(n, F.col("text").rlike(p)) for n, p in FLAGS]
    return t("documents").select("doc_id", F.array_join(R.flags(*rules, ("too_short", F.col("n_chars") < 120)), ",").alias("flags"))


COLLEGES = ["tion", "keit", "ción"]


@query("college_infer", "SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'keit') THEN 'keit' WHEN contains(text, 'ción') THEN 'ción' END AS college FROM documents")
def college_infer(t):
    return t("documents").select("doc_id", R.infer_by_list(F.col("text"), COLLEGES).alias("college"))


#: Well-formed ids with right and wrong check digits beside order keys.
@query("pii_idcard", "WITH k AS (SELECT o_orderkey, '110101' || CAST(1950 + o_orderkey % 60 AS VARCHAR) || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN o_orderkey % 11 = 10 THEN 'x' ELSE CAST(o_orderkey % 11 AS VARCHAR) END AS id FROM orders), s AS (SELECT o_orderkey, id, list_sum(list_transform(range(1, 18), lambda i: CAST(id[i] AS INTEGER) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) % 11 AS m FROM k) SELECT o_orderkey, '10X98765432'[CAST(m AS INTEGER) + 1] = upper(id[18]) AS valid FROM s")
def pii_idcard(t):
    k = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    id_ = F.concat(F.lit("110101"), (k % 60 + 1950).cast("string"), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2), pad(k % 1000, 3), F.when(k % 11 == 10, "x").otherwise((k % 11).cast("string")))
    return t("orders").select(k, (F.size(R.id_cards(F.concat(F.lit("no. "), id_, F.lit(".")))) > 0).alias("valid"))


@query("pii_student_id", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:token|Version|version)\s*[:：]?\s*\d{2,20}')) AS BIGINT) AS n FROM documents")
def pii_student_id(t):
    """The detector with the context words of the test texts, whose numbers are shorter."""
    return t("documents").select("doc_id", R.student_ids(F.col("text"), ["token", "Version", "version"], "{2,20}").alias("n"))


@query("pii_mobile", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\d{3}-\d{4}')) AS BIGINT) AS n FROM documents")
def pii_mobile(t):
    return t("documents").select("doc_id", R.mobiles(F.col("text"), r"\d{3}-\d{4}").alias("n"))


PII = r"WITH p AS (SELECT doc_id, len(regexp_extract_all(text, '(?:token|license)\s*[:：]?\s*\d{8,20}')) AS st, len(regexp_extract_all(text, '\d{3}-\d{4}')) AS mo, contains(regexp_extract(text, '^([^\n]*)', 1), 'the') AS roster FROM documents), q AS (SELECT *, mo >= 3 OR (mo > 0 AND (st > 0 OR roster)) AS many FROM p) "


@query("pii_roster", PII + "SELECT doc_id, many FROM q")
def pii_roster(t):
    x = t("documents").select("doc_id", "text", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))
    p = R.pii(x, "text", "title", mobile=r"\d{3}-\d{4}", id_words=["token", "license"], roster="the")
    return p.select("doc_id", F.array_contains("pii_categories", "mobile").alias("many"))


@query("pii_risk", r"WITH p AS (SELECT doc_id, len(regexp_extract_all(text, '\d{3}-\d{4}')) AS mo, contains(regexp_extract(text, '^([^\n]*)', 1), 'the') AS roster FROM documents) SELECT doc_id, CASE WHEN mo >= 3 OR (mo > 0 AND roster) THEN 'mobile' ELSE '' END AS categories, CAST(CASE WHEN mo >= 3 OR (mo > 0 AND roster) THEN mo ELSE 0 END AS BIGINT) AS n, CASE WHEN NOT (mo >= 3 OR (mo > 0 AND roster)) THEN 'NONE' WHEN mo >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM p")
def pii_risk(t):
    x = t("documents").select("doc_id", "text", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))
    return R.pii(x, "text", "title", mobile=r"\d{3}-\d{4}", roster="the").select("doc_id", F.array_join("pii_categories", ",").alias("categories"), F.col("pii_count").alias("n"), F.col("pii_risk").alias("risk"))


@query("contact_flag", r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._]+@[a-z0-9]+\.') AND regexp_matches(text, '\d{3}-\d{4}') AS contact FROM documents")
def contact_flag(t):
    return t("documents").select("doc_id", R.public_contact(F.col("text"), r"\d{3}-\d{4}").alias("contact"))


QUESTIONS = [("q_lic", "scholarship", "licen[cs]e"), ("q_ver", "scholarship", r"version \d"), ("q_mail", "scholarship", "@mail"), ("q_for", "exam", "und der|der und"), ("q_ung", "exam", "ung "), ("q_ion", "library", "ion "), ("q_eau", "library", "eau"), ("q_cion", "holiday", "ción"), ("q_num", "holiday", r"\d"), ("q_tok", "scholarship", "token"), ("q_wor", "scholarship", "worthless|idiot"), ("q_bar", "exam", r" \| ")]
TAGS = BASE + ", g AS (SELECT *, list_sort(list_filter([" + ", ".join(f"CASE WHEN topic = '{k}' AND regexp_matches(text, '(?is){p}') THEN '{q}' END" for q, k, p in QUESTIONS) + "], lambda x: x IS NOT NULL)) AS tags FROM c) "


def tagged(t):
    c = classified(t)
    return c.withColumn("tags", A.evidence_tags(c, QUESTIONS, "topic", F.col("text")))


@query("evidence_tags", TAGS + "SELECT doc_id, array_to_string(tags, ',') AS tags FROM g")
def evidence_tags(t):
    return tagged(t).select("doc_id", F.array_join("tags", ",").alias("tags"))


REJ = "list_filter([CASE WHEN n_chars < 120 THEN 'content_too_short' END, CASE WHEN n_chars > 12000 THEN 'bulk_table_or_oversized_content' END, CASE WHEN role = 'RESULT_ANNOUNCEMENT' THEN 'result_or_blank_form' END, CASE WHEN len(tags) = 0 THEN 'no_question_evidence' END, CASE WHEN source IN ('src3', 'src4') THEN 'authority_not_verified' END, CASE WHEN contains(text, '!!') THEN 'quality:shouting' END, CASE WHEN contains(text, ' | ') THEN 'quality:table_layout' END], lambda x: x IS NOT NULL)"


def _reasons():
    x = F.col("text")
    return F.array_sort(F.array_distinct(X.reasons(("content_too_short", F.col("n_chars") < 120), ("bulk_table_or_oversized_content", F.col("n_chars") > 12000), ("result_or_blank_form", F.col("role") == "RESULT_ANNOUNCEMENT"), ("no_question_evidence", F.size("tags") == 0), ("authority_not_verified", F.col("source").isin("src3", "src4")), ("quality:shouting", x.contains("!!")), ("quality:table_layout", x.contains(" | ")))))


@query("rejection_reasons", TAGS + f"SELECT doc_id, array_to_string(list_sort({REJ}), ',') AS reasons FROM g")
def rejection_reasons(t):
    return tagged(t).select("doc_id", F.array_join(_reasons(), ",").alias("reasons"))


@query("reason_counts", TAGS + f"SELECT reason, count(*) AS n FROM (SELECT unnest({REJ}) AS reason FROM g) GROUP BY 1")
def reason_counts(t):
    return tagged(t).select(F.explode(_reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


ELIG = TAGS + f", e AS (SELECT doc_id, topic, tags, n_chars, lang FROM g WHERE len({REJ}) = 0) "


def eligible(t):
    """What no rule rejects: settled, as several queries read it more than once, and so that
    the filter isn't pushed below the projection, where it would test every pattern again."""
    d = settle(tagged(t).select("doc_id", "topic", "tags", "n_chars", "lang", _reasons().alias("reasons")))
    return d.where(F.size("reasons") == 0).drop("reasons")


@query("latest_by_question", ELIG + ", u AS (SELECT doc_id, n_chars, unnest(tags) AS tag FROM e) SELECT tag, arg_max(doc_id, struct_pack(a := n_chars, b := doc_id)) AS latest_id, count(*) AS n FROM u GROUP BY 1")
def latest_by_question(t):
    return A.latest_by_tag(eligible(t), "doc_id", "tags", ["n_chars"])


@query("greedy_cover", ELIG.replace("WITH ", "WITH RECURSIVE ", 1) + """, best_of AS (SELECT topic, list_sort(tags) AS tags, arg_max(doc_id, struct_pack(a := n_chars, b := doc_id)) AS id, max(n_chars) AS n FROM e WHERE len(tags) > 0 GROUP BY topic, list_sort(tags)),
all_tags AS (SELECT topic, list(DISTINCT tag) AS missing FROM (SELECT topic, unnest(tags) AS tag FROM best_of) GROUP BY 1),
rounds AS (SELECT b.topic, b.tags, b.id, b.n, a.missing, CAST([] AS BIGINT[]) AS past, 0 AS pick, 0::BIGINT AS gain, false AS taken FROM best_of b JOIN all_tags a USING (topic)
UNION ALL SELECT topic, tags, id, n, list_filter(missing, lambda x: NOT list_contains(best, x)), list_prepend(now, past), pick + 1, now, r = 1
FROM (SELECT *, row_number() OVER w AS r, first_value(tags) OVER w AS best FROM (SELECT *, len(list_intersect(tags, missing)) AS now FROM rounds WHERE NOT taken AND len(missing) > 0) WINDOW w AS (PARTITION BY topic ORDER BY now DESC, n DESC, past DESC, id DESC)))
SELECT topic, id, CAST(pick AS INTEGER) AS pick, CAST(gain AS INTEGER) AS gain FROM rounds WHERE taken""")
def greedy_cover(t):
    return A.greedy_cover(eligible(t), "topic", "doc_id", "tags", ["n_chars"])


@query("capped_extras", ELIG + ", f AS (SELECT topic, arg_max(doc_id, struct_pack(a := n_chars, b := doc_id)) AS id FROM e GROUP BY 1), l AS (SELECT arg_max(doc_id, struct_pack(a := n_chars, b := doc_id)) AS id FROM (SELECT doc_id, n_chars, unnest(tags) AS tag FROM e) GROUP BY tag), x AS (SELECT e.topic, e.doc_id, row_number() OVER (PARTITION BY e.topic ORDER BY n_chars DESC, e.doc_id DESC) AS n FROM e WHERE doc_id NOT IN (SELECT id FROM f) AND (doc_id IN (SELECT id FROM l) OR (e.topic = 'scholarship' AND doc_id IN (SELECT doc_id FROM documents WHERE contains(text, 'tion') OR contains(text, 'keit') OR contains(text, 'ción'))))) SELECT topic, id, 'cover' AS kind FROM f UNION ALL SELECT topic, doc_id, 'extra' FROM x WHERE n <= CASE WHEN topic = 'scholarship' THEN 31 ELSE 11 END")
def capped_extras(t):
    """Extras are the latest for a question; in the topic with the larger cap also what a
    college says of itself. Documents have no date, so all years count."""
    college = t("documents").where(R.infer_by_list(F.col("text"), COLLEGES).isNotNull()).select("doc_id", F.lit(True).alias("of_college")).distinct()
    e = settle(eligible(t).join(college, "doc_id", "left"))
    cover = e.groupBy("topic").agg(F.max(F.struct("n_chars", "doc_id"))["doc_id"].alias("id"))
    latest = A.latest_by_tag(e, "doc_id", "tags", ["n_chars"])
    wide = F.col("topic") == "scholarship"
    return A.capped_extras(e, cover, latest, "topic", "doc_id", [F.desc("n_chars"), F.desc("doc_id")], F.when(wide, 32).otherwise(12), 32, wide & F.col("of_college"))


@query("accept_split", ELIG + "SELECT d.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'ACCEPTED' ELSE 'REVIEW' END AS status FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id")
def accept_split(t):
    e = eligible(t).select("doc_id").distinct().withColumn("hit", F.lit(True))
    j = t("documents").select("doc_id").join(e, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("hit"), "ACCEPTED").otherwise("REVIEW").alias("status"))


@query("coverage_by_topic", ELIG + ", v AS (SELECT tag AS id, bool_or(n_chars > 3000) AS latest FROM (SELECT unnest(tags) AS tag, n_chars FROM e) GROUP BY 1), q(id, topic, fresh) AS (VALUES " + ", ".join(f"('{q}', '{k}', {str(i % 2 == 0).lower()})" for i, (q, k, _) in enumerate(QUESTIONS)) + ") SELECT topic, count(*) FILTER (WHERE latest IS NOT NULL AND (NOT fresh OR latest)) AS covered, count(*) AS total, round(count(*) FILTER (WHERE latest IS NOT NULL AND (NOT fresh OR latest)) / count(*), 4) AS rate FROM q LEFT JOIN v USING (id) GROUP BY 1")
def coverage_by_topic(t):
    q = t.spark.createDataFrame([(q, k, i % 2 == 0) for i, (q, k, _) in enumerate(QUESTIONS)], "id string, topic string, fresh boolean")
    ev = eligible(t).select(F.explode("tags").alias("id"), (F.col("n_chars") > 3000).alias("latest"))
    return A.coverage(q, ev)


@query("canary_first", ELIG + "SELECT topic, min(doc_id) AS doc_id FROM e GROUP BY 1")
def canary_first(t):
    return eligible(t).groupBy("topic").agg(F.min("doc_id").alias("doc_id"))


TAXONOMY = {"audience": ["ALL", "UNDERGRADUATE", "GRADUATE"], "secondary_topic": ["scholarship", "exam", "library", "other"]}
DOC = BASE + ", k AS (SELECT c.*, d.review_status, d.pii_detected, d.source_id <> 'src3' AS source_active, sha256(c.text) AS content_hash, CASE WHEN contains(c.text, 'that') THEN 'ALL' ELSE 'UNKNOWN' END AS audience FROM c JOIN kb_documents d ON d.doc_id = c.doc_id) "


def documents(t):
    k = t.kb_documents().select("doc_id", "review_status", "pii_detected", (F.col("source_id") != "src3").alias("source_active"), "rag_eligible")
    d = classified(t).join(k, "doc_id")
    h = F.sha2("text", 256)
    return d.select("doc_id", "text", "source", F.lit("s1").alias("school_id"), "review_status", "source_active", F.when(F.col("doc_id") % 17 == 0, "FAILED").otherwise("PARSED").alias("parse_status"), F.col("n_chars").alias("content_chars"), F.lit("n/1").alias("normalized_path"), h.alias("content_hash"), F.lit("CLEAR").alias("pii_scan_status"), "pii_detected", F.when(F.col("doc_id") % 19 == 0, "old").otherwise(h).alias("pii_content_hash"), F.when(F.col("text").contains("that"), "ALL").otherwise("UNKNOWN").alias("audience"), F.col("topic").alias("secondary_topic"), F.when(F.col("doc_id") % 23 == 0, F.col("doc_id")).alias("canonical_document_id"), (F.col("doc_id") % 4 == 1).alias("is_attachment"), F.when(F.col("doc_id") % 8 == 1, F.col("doc_id")).alias("parent_id"), F.col("role").alias("content_role"), "rag_eligible")


GATE = "list_filter([CASE WHEN review_status <> 'ACCEPTED' THEN 'review_required' END, CASE WHEN NOT source_active THEN 'source_inactive' END, CASE WHEN doc_id % 17 = 0 THEN 'parse_not_verified' END, CASE WHEN n_chars NOT BETWEEN 100 AND 100000 THEN 'invalid_text_length' END, CASE WHEN pii_detected THEN 'pii_not_cleared' END, CASE WHEN doc_id % 19 = 0 THEN 'pii_scan_stale' END, CASE WHEN audience = 'UNKNOWN' THEN 'invalid_audience' END, CASE WHEN topic NOT IN ('scholarship', 'exam', 'library', 'other') THEN 'invalid_secondary_topic' END, CASE WHEN topic = 'other' THEN 'unclassified_topic' END, CASE WHEN doc_id % 23 = 0 THEN 'duplicate_content' END, CASE WHEN doc_id % 4 = 1 AND doc_id % 8 <> 1 THEN 'attachment_parent_unresolved' END], lambda x: x IS NOT NULL)"


@query("admission_gate", DOC + f"SELECT doc_id, array_to_string({GATE}, ',') AS reasons FROM k")
def admission_gate(t):
    return documents(t).select("doc_id", F.array_join(A.admission_reasons(school="s1", taxonomy=TAXONOMY), ",").alias("reasons"))


@query("scope_gate", DOC + f"SELECT doc_id, len({GATE}) = 0 AND topic = 'scholarship' AND doc_id % 3 <> 0 AS allowed FROM k")
def scope_gate(t):
    d = documents(t)
    d = d.withColumn("admission_status", F.when(F.size(A.admission_reasons(school="s1", taxonomy=TAXONOMY)) == 0, "READY").otherwise("HELD"))
    d = d.withColumns({"source_content_hash": F.sha2(F.concat("text", F.lit("|source")), 256), "answer_scope": F.lit("FORM_ONLY"), "rag_eligible": F.lit(1)})
    d = d.withColumn("review_evidence", F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, "2019").otherwise("2024").alias("applicable_period"), "source_content_hash")))
    return d.select("doc_id", A.in_scope(school="s1", topic="scholarship", period="2024").alias("allowed"))


REVIEW = f"WITH v AS (SELECT d.doc_id, d.text, b.text AS proof, trim(regexp_replace(d.text, '{WS}', ' ', 'g')) AS body, trim(regexp_replace(b.text, '{WS}', ' ', 'g')) AS want FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id) "


def benchmark_size(t):
    """The modulus under which every benchmark item has documents."""
    return (t("benchmark").agg(F.max("item_id")).first()[0] or 0) + 1


@query("review_reasons", REVIEW + "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'review_source_hash_mismatch' END, CASE WHEN doc_id % 5 = 0 THEN 'explicit_answer_scope_required' END, CASE WHEN doc_id % 6 = 0 THEN 'scope_note_required' END, CASE WHEN NOT (length(proof) >= 12 AND contains(body, want)) THEN 'review_evidence_missing_or_changed' END, CASE WHEN doc_id % 9 = 0 THEN 'review_document_role_required' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v")
def review_reasons(t):
    k = F.col("doc_id")
    b = t("benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("proof"))
    v = t("documents").withColumn("item", k % benchmark_size(t)).join(b, "item")
    v = v.withColumns({"source_hash": F.sha2("text", 256), "scope": F.when(k % 5 != 0, "FORM_ONLY"), "note": F.when(k % 6 != 0, "n"), "role": F.when(k % 9 == 0, "OTHER").otherwise("GUIDE")})
    v = v.withColumn("review_hash", F.when(k % 7 == 0, "old").otherwise(F.col("source_hash")))
    return v.select("doc_id", F.array_join(A.review_reasons("text", ["GUIDE"]), ",").alias("reasons"))


@query("release_split", DOC + f"SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN 'released_by_review' WHEN len({GATE}) = 0 THEN 'released' ELSE 'held' END AS outcome FROM k")
def release_split(t):
    """Reviews override the gate; all that neither lets through is held."""
    d = documents(t)
    review = t("documents").where("doc_id % 6 = 2").select("doc_id", F.lit("released_by_review").alias("override"))
    gate = F.when(F.size(A.admission_reasons(school="s1", taxonomy=TAXONOMY)) == 0, "released").otherwise("held")
    return d.join(review, "doc_id", "left").select("doc_id", F.coalesce("override", gate).alias("outcome"))


@query("attachment_parent", "SELECT DISTINCT child_id FROM relations WHERE parent_id IN (SELECT doc_id FROM kb_documents WHERE review_status = 'ACCEPTED') AND (child_id % 3 <> 1 OR child_id % 2 = 1)")
def attachment_parent(t):
    """Attachments of reviewed parents; for every third a parent was chosen, for the even ones
    of these another than it has."""
    r = t.relations()
    chosen = r.where("child_id % 3 = 1").select("child_id", F.when(F.col("child_id") % 2 == 1, F.col("parent_id")).otherwise(-1).alias("parent_id"))
    return A.reviewed_attachments(r, t.kb_documents().where("review_status = 'ACCEPTED'"), chosen)


NOISE = DOC + ", z AS (SELECT *, CASE WHEN doc_id % 17 = 0 OR n_chars NOT BETWEEN 100 AND 100000 THEN 'INVALID_PARSE_PII_OR_TEXT' WHEN doc_id % 10 = 3 THEN NULL WHEN role IN ('NEWS', 'RESULT_ANNOUNCEMENT', 'NON_STUDENT') THEN 'NEWS_RESULT_OR_NON_STUDENT' WHEN role = 'FORM_TEMPLATE' THEN 'FORM_OR_UNSUPPORTED_ARCHIVE' WHEN topic = 'other' OR role = 'UNKNOWN' OR audience = 'UNKNOWN' THEN 'UNRESOLVED_SEMANTIC_SCOPE' WHEN role = 'ANNUAL_NOTICE' AND doc_id % 2 = 0 THEN 'STALE_ANNUAL_NOTICE' END AS reason FROM k) "


def noise(t):
    k = F.col("doc_id")
    d = documents(t).withColumns({"admission_status": F.when(k % 10 == 3, "READY").otherwise("HELD"), "semantic_status": F.lit(""), "parse_format": F.lit("html"), "publish_date": F.when(k % 2 == 0, "2020-01-01").otherwise("2024-01-01")})
    return settle(d.select("doc_id", "is_attachment", A.noise_reason().alias("reason")))


@query("noise_reason", NOISE + "SELECT doc_id, reason FROM z")
def noise_reason(t):
    return noise(t).select("doc_id", "reason")


@query("deletion_reasons", NOISE + "SELECT reason, count(*) AS n FROM z WHERE reason IS NOT NULL GROUP BY 1")
def deletion_reasons(t):
    return noise(t).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("cascade_delete", NOISE + "SELECT 'labels' AS part, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM z WHERE reason IS NOT NULL) UNION ALL SELECT 'relations', count(*) FROM relations WHERE child_id NOT IN (SELECT doc_id FROM z WHERE reason IS NOT NULL)")
def cascade_delete(t):
    gone = noise(t).where("reason is not null").select("doc_id")
    a = t("labels").join(gone, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("labels").alias("part"), "n")
    b = t.relations().join(gone.withColumnRenamed("doc_id", "child_id"), "child_id", "left_anti").agg(F.count("*").alias("n"))
    return a.union(b.select(F.lit("relations"), "n"))


@query("orphan_prune", NOISE.replace("WITH ", "WITH RECURSIVE ", 1) + """, kids AS (SELECT DISTINCT r.child_id, r.parent_id FROM relations r JOIN z ON z.doc_id = r.child_id WHERE z.doc_id % 4 = 1),
rounds AS (SELECT 0 AS n, doc_id, reason IS NOT NULL AS removed, doc_id % 4 = 1 AS is_attachment, reason IS NOT NULL OR (doc_id % 4 = 1 AND doc_id NOT IN (SELECT child_id FROM kids)) AS gone FROM z WHERE doc_id % 4 = 1 OR reason IS NOT NULL
UNION ALL SELECT c.n + 1, c.doc_id, c.removed, c.is_attachment, c.gone OR (c.is_attachment AND bool_and(coalesce(p.gone, false))) FROM rounds c LEFT JOIN kids k ON k.child_id = c.doc_id LEFT JOIN rounds p ON p.doc_id = k.parent_id WHERE c.n < 25 GROUP BY c.n, c.doc_id, c.removed, c.is_attachment, c.gone)
SELECT doc_id FROM rounds WHERE n = 25 AND gone AND NOT removed""")
def orphan_prune(t):
    d = noise(t)
    return A.prune_orphans(d.select("doc_id", "is_attachment"), t.relations(), d.where("reason is not null").select("doc_id"))


@query("bundles", "SELECT parent_id, array_to_string(list_sort(list(DISTINCT child_id)), ',') AS children, count(DISTINCT child_id) AS members, 'bundle_' || left(sha256(CAST(parent_id AS VARCHAR)), 16) AS bundle_id FROM relations GROUP BY 1")
def bundles(t):
    return A.bundles(t.relations()).withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


@query("relations_ready", "SELECT child_id, parent_id FROM relations WHERE child_id IN (SELECT doc_id FROM kb_documents WHERE rag_eligible) AND parent_id IN (SELECT doc_id FROM kb_documents WHERE rag_eligible)")
def relations_ready(t):
    return A.ready_relations(t.relations(), t.kb_documents().where("rag_eligible"))


@query("delivery_checks", "WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h OR a.doc_id IS NULL OR b.doc_id IS NULL")
def delivery_checks(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    b = d.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 8 == 0, "x").otherwise(F.col("h")))
    return A.difference(d.where("doc_id % 9 <> 0"), b, "doc_id", "h")


@query("canary_minimums", "WITH o AS (SELECT lang, count(*) FILTER (WHERE n_chars > 1000) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1), r(lang, need) AS (VALUES ('en', 100), ('de', 5000), ('xx', 1)) SELECT r.lang, coalesce(n, 0) AS n, coalesce(sources, 0) AS sources, coalesce(n, 0) >= need AS ok FROM r LEFT JOIN o USING (lang)")
def canary_minimums(t):
    need = t.spark.createDataFrame([("en", 100), ("de", 5000), ("xx", 1)], "lang string, need long")
    o = t("documents").groupBy("lang").agg(F.count_if(F.col("n_chars") > 1000).alias("n"), F.countDistinct("source").alias("sources"))
    return A.minimums(need, o, "lang").select("lang", "n", "sources", "ok")


@query("export_validate", "WITH e AS (SELECT doc_id, sha256(text) AS h, lang FROM documents UNION ALL SELECT doc_id, sha256(text), lang FROM documents WHERE doc_id % 40 = 1) SELECT (SELECT count(*) FROM (SELECT doc_id FROM e GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids, (SELECT count(*) FROM (SELECT h FROM e GROUP BY 1 HAVING count(*) > 1)) AS duplicate_hashes, count(*) FILTER (WHERE f.doc_id IS NULL) AS missing_files, count(*) FILTER (WHERE f.h <> e.h) AS hash_mismatches, count(*) FILTER (WHERE coalesce(lang, '') = '') AS missing_metadata FROM e LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0) f ON f.doc_id = e.doc_id")
def export_validate(t):
    """Every fortieth document is exported twice; files are missing or differ."""
    e = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    f = e.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "x").otherwise(F.col("h")).alias("h"))
    return A.export_faults(e.union(e.where("doc_id % 40 = 1")), f, "doc_id", "h", ["lang"])


@query("enrich_stats", BASE + "SELECT count(*) AS rows_, count(*) FILTER (WHERE role <> 'UNKNOWN') AS role_changed, count(*) FILTER (WHERE topic <> 'other') AS topic_changed FROM c")
def enrich_stats(t):
    return classified(t).agg(F.count("*").alias("rows_"), F.count_if(F.col("role") != "UNKNOWN").alias("role_changed"), F.count_if(F.col("topic") != "other").alias("topic_changed"))


@query("ledger_admit", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def ledger_admit(t):
    l = t("benchmark").select("item_id", F.col("text").alias("excerpt"))
    j = contains_join(t("documents").select("doc_id", "text"), l, "doc_id", "text", "excerpt")
    return j.join(t("labels").where("quality = 0"), "doc_id", "left_anti").select("doc_id", "item_id")


@query("ledger_reasons", r"""WITH p AS (SELECT min(page_id) AS sid, url FROM pages GROUP BY url), m AS (SELECT sid, url, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z]+://', ''), '/$', '') AS k FROM p),
own AS (SELECT m.sid, d.text, d.source, d.lang FROM m JOIN documents d ON d.doc_id = m.sid WHERE m.sid % 6 <> 5),
by_key AS (SELECT m.k, min(m.sid) AS doc_id FROM m JOIN own USING (sid) GROUP BY 1), inv AS (SELECT k FROM m WHERE sid % 13 = 0),
c AS (SELECT m.sid, m.url, m.k, d.doc_id, d.text, d.source, d.lang, regexp_replace(d.text, '[\s\x1c-\x1f\x{85}\p{Z}]+', '', 'g') AS body FROM m JOIN by_key b ON b.k = m.k JOIN documents d ON d.doc_id = b.doc_id),
led AS (SELECT sid, source AS topic, CASE WHEN sid % 7 = 0 THEN 'an excerpt that no document has' ELSE substr(text, 11, 30) END AS ex, CASE WHEN sid % 5 = 0 THEN [lang, 'fees'] ELSE [lang] END AS intents FROM own WHERE sid % 8 <> 3),
r AS (SELECT m.sid, c.doc_id, list_filter([
CASE WHEN m.sid % 9 = 2 THEN 'route_not_static_document' END, CASE WHEN led.sid IS NULL THEN 'no_completed_evidence_review' END, CASE WHEN c.sid IS NULL THEN 'source_body_not_parsed' END,
CASE WHEN c.sid IS NOT NULL AND contains(c.text, '!!') THEN 'quality:shouting' END, CASE WHEN c.sid IS NOT NULL AND contains(c.text, '@') THEN 'pii_detected' END, CASE WHEN length(c.body) < 120 THEN 'content_too_short' END,
CASE WHEN c.sid IS NOT NULL AND (c.doc_id % 11 = 0 OR m.k IN (SELECT k FROM inv)) THEN 'already_in_current_knowledge_base' END, CASE WHEN c.sid IS NOT NULL AND sha256(c.text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 17 = 0) THEN 'duplicate_current_clean_content' END,
CASE WHEN led.sid IS NOT NULL AND led.topic = 'src1' THEN 'topic_not_in_taxonomy' END, CASE WHEN led.sid IS NOT NULL AND c.sid IS NOT NULL AND NOT contains(c.body, regexp_replace(led.ex, '[\s\x1c-\x1f\x{85}\p{Z}]+', '', 'g')) THEN 'evidence_excerpt_missing:' || left(led.ex, 24) END,
CASE WHEN led.sid IS NOT NULL AND c.sid IS NOT NULL AND m.sid % 5 = 0 AND m.sid % 10 <> 0 THEN 'intent_not_declared_for_source:fees' END], lambda x: x IS NOT NULL) AS reasons FROM m LEFT JOIN c USING (sid) LEFT JOIN led USING (sid))
SELECT sid AS source_id, doc_id AS candidate_id, array_to_string(list_sort(reasons), '|') AS reasons FROM r""")
def ledger_reasons(t):
    """Reviewed sources against parsed candidates and what is there already; pages stand for
    sources, documents of the same number for their text."""
    p = t("pages").groupBy("url").agg(F.min("page_id").alias("source_id"))
    k = F.col("source_id")
    sources = p.select("source_id", "url", F.when(k % 9 == 2, "other").otherwise("static").alias("source_route"))
    d = p.join(t("documents").withColumnRenamed("doc_id", "source_id"), "source_id").where(k % 6 != 5)
    flags = F.array_compact(F.array(F.when(F.contains("text", F.lit("!!")), "shouting"), F.when(F.contains("text", F.lit("a")), "harmless")))
    candidates = d.select(k.alias("candidate_id"), F.regexp_replace("url", "^https?:", "http:").alias("url"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), flags.alias("quality_flags"), F.contains("text", F.lit("@")).alias("contains_pii"))
    excerpt = F.when(k % 7 == 0, "an excerpt that no document has").otherwise(F.substring("text", 11, 30))
    ledger = d.where(k % 8 != 3).select("source_id", F.col("source").alias("topic"), F.array(excerpt).alias("excerpts"), F.when(k % 5 == 0, F.array("lang", F.lit("fees"))).otherwise(F.array("lang")).alias("intents"))
    questions = d.select("source_id", F.explode(F.when(k % 10 == 0, F.array("lang", F.lit("fees"))).otherwise(F.array("lang"))).alias("intent"))
    none = F.lit(None).cast("string")
    by_id = t("documents").where("doc_id % 11 = 0").select(F.col("doc_id").alias("candidate_id"), none.alias("url"), none.alias("content_hash"))
    by_url = p.where(k % 13 == 0).select(F.lit(None).cast("long").alias("candidate_id"), "url", none.alias("content_hash"))
    by_hash = t("documents").where("doc_id % 17 = 0").select(F.lit(None).cast("long").alias("candidate_id"), none.alias("url"), F.sha2("text", 256).alias("content_hash"))
    topics = [f"src{i}" for i in range(100) if i != 1]
    found = A.ledger_admission(sources, candidates, ledger, questions, by_id.union(by_url).union(by_hash), topics, "static", ["shouting"])
    return found.withColumn("reasons", F.array_join("reasons", "|"))


@query("intent_support", ELIG + ", u AS (SELECT doc_id, n_chars, unnest(tags) AS tag FROM e) SELECT tag, count(*) FILTER (WHERE n_chars > 3000) AS full_, count(*) FILTER (WHERE n_chars <= 3000) AS partial_, array_to_string(list_sort(list(doc_id) FILTER (WHERE n_chars > 3000))[1:3], ',') AS examples FROM u GROUP BY 1")
def intent_support(t):
    u = eligible(t).select("doc_id", "n_chars", F.explode("tags").alias("tag"))
    full = F.col("n_chars") > 3000
    w = Window.partitionBy("tag", "full").orderBy("doc_id")
    counts = u.groupBy("tag").agg(F.count_if(full).alias("full_"), F.count_if(~full).alias("partial_"))
    # the first three of a tag by rank, never the whole list of a tag in one row
    first = u.withColumn("full", full).withColumn("n", F.row_number().over(w)).where("n <= 3 and full").groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(first, "tag", "left")
