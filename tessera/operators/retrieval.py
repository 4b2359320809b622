"""Routing of questions, evidence resolution, ranking, merging and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical_ends, first_present, scoped_id, truncated
from ..functions.urls import allowed_or_empty, public_or_empty

#: Greetings, polite openings and the separators after them.
GREETINGS = ["hello", "您好", "你好", "哈喽", "在吗", "hi", "嗨"]
POLITE = ["能不能帮我看看", "麻烦帮我看看", "请帮我查一下", "我想请教一下", "想请教一下", "我想问一下", "麻烦问一下", "想问一下", "请问"]
#: Questions about the product itself, and the integration probes.
INTRODUCTIONS = ["你是谁", "你能做什么", "介绍一下你自己", "介绍一下自己"]
PROBES = ["官网搜索测试", "web-search"]
SEPARATORS = r"[\s，,。.!！?？:：;；、]"
#: What marks a question as one about the present state, in order.
FRESHNESS = [
    ("freshness_status_question", "还能不能|还能|现在能不能|开始了吗|结束了吗|开放了吗|报名了吗|是否有效|还有效吗|是否已经|有没有开始"),
    ("freshness_current_marker", "现在|目前|当前|最新|最近|今年|本年度|本学年|本学期|这学期|下学期|本轮|这次|近期|今天|明天|本周|下周|本月|明年"),
]
SCHEDULE = "什么时候|何时|几号|几点|时间|日期|截止|开始|结束|放假|开学|开门|关门"
DYNAMIC = "校历|报名|考试|选课|开放|最新政策|本年度通知"
STABLE = "是什么|在哪里|在哪儿|什么条件|哪些.{0,4}条件|基本条件|一般怎么|如何理解|什么意思"
YEAR = r"(?:^|[^0-9])((?:19|20|21)[0-9]{2})(?:\s*年|\s*[-—–/]\s*((?:19|20|21)[0-9]{2})\s*(?:学年|年))"


def stripped(question: Column, greetings: list[str] = GREETINGS, polite: list[str] = POLITE) -> Column:
    """Without greetings and polite openings, as often as they come. A greeting goes only
    if a separator, a particle, a polite opening or the end follows it, so words that
    merely begin like one stay."""
    q = F.btrim(F.regexp_replace(question, r"(?U)\s+", " "))
    p = "|".join(sorted(polite, key=len, reverse=True))
    g = "|".join(sorted(greetings, key=len, reverse=True))
    one = f"(?:(?i:{g})(?:[呀啊哦哟]?$|[呀啊哦哟]?{SEPARATORS}+|[呀啊哦哟]?(?={p}))|(?:{p}){SEPARATORS}*)"
    return F.regexp_replace(q, f"^(?:{one})+", "")


def freshness(question: Column, year: int, rules=FRESHNESS, schedule: str = SCHEDULE, dynamic: str = DYNAMIC, stable: str = STABLE, year_pattern: str = YEAR) -> Column:
    """Struct of level and reason: the first rule that the question meets."""
    years = F.concat(F.regexp_extract_all(question, F.lit(year_pattern), F.lit(1)), F.regexp_extract_all(question, F.lit(year_pattern), F.lit(2)))
    now = F.exists(years, lambda y: F.coalesce(y.try_cast("int") >= year, F.lit(False)))
    reason = F.lit(None).cast("string")
    reason = F.when(question.rlike(rules[0][1]), rules[0][0])
    for name, p in rules[1:]:
        reason = reason.when(question.rlike(p), name)
    reason = reason.when(now, "freshness_current_year").when(F.size(years) > 0, "historical_explicit_year").when(question.rlike(schedule), "freshness_schedule_question").when(question.rlike(dynamic) & ~question.rlike(stable), "freshness_dynamic_information").otherwise("stable_campus_knowledge")
    level = F.when(reason.isin("historical_explicit_year"), "HISTORICAL").when(reason == "stable_campus_knowledge", "STABLE").otherwise("CURRENT")
    return F.struct(level.alias("level"), reason.alias("reason"))


def profile(question: Column, year: int, introductions: list[str] = INTRODUCTIONS, probes: list[str] = PROBES, greetings: list[str] = GREETINGS) -> Column:
    """Struct of effective question, social, introduction, probe, level and reason. A
    question that is nothing but greetings is social; one that is nothing but politeness
    stays as it was written."""
    left = stripped(question, greetings)
    social = (left == "") & question.rlike(f"(?i){'|'.join(greetings)}")
    effective = F.when((left == "") & ~social, F.btrim(question)).otherwise(left)
    bare = F.replace(F.lower(F.regexp_replace(effective, f"(?U)^{SEPARATORS}+|{SEPARATORS}+$", "")), F.lit(" "), F.lit(""))
    intro, probe = bare.isin(introductions), bare.isin(probes)
    fresh = freshness(effective, year)
    level = F.when(social | intro, "STABLE").otherwise(fresh["level"])
    reason = F.when(social, "pure_social").when(intro, "product_introduction").when(probe, "integration_probe").otherwise(fresh["reason"])
    return F.struct(effective.alias("effective"), social.alias("social"), intro.alias("introduction"), probe.alias("probe"), level.alias("level"), reason.alias("reason"))


def route(level: Column, social: Column, intro: Column, probe: Column) -> Column:
    return F.when(social | intro, "controlled").when(probe, "web_search").when(level == "CURRENT", "hybrid").otherwise("knowledge")


def plan_valid(route_: Column, has_answer: Column, has_search: Column, has_knowledge: Column) -> Column:
    return F.when(route_ == "controlled", has_answer & ~has_search & ~has_knowledge).when(route_ == "web_search", has_search & ~has_knowledge).when(route_ == "knowledge", has_knowledge & ~has_search).when(route_ == "hybrid", has_search & has_knowledge).otherwise(False)


def resolve(mappings: DataFrame, documents: DataFrame, sources: DataFrame, attachments: DataFrame) -> DataFrame:
    """Imported mappings with their admitted document, active source and, where one is
    named, admitted attachment. A named attachment that isn't admitted drops the row."""
    ok = lambda p: F.col(f"{p}.rag_eligible") & ~F.col(f"{p}.pii_detected") & (F.col(f"{p}.review_status") == "ACCEPTED")
    m = mappings.where("import_status = 'IMPORTED'").alias("m")
    j = m.join(documents.alias("d"), F.col("m.doc_id") == F.col("d.doc_id")).where(ok("d"))
    j = j.join(sources.where("active").alias("s"), F.col("d.source_id") == F.col("s.source_id"))
    j = j.join(attachments.alias("a"), (F.col("m.attachment_id") == F.col("a.attachment_id")) & (F.col("a.doc_id") == F.col("d.doc_id")), "left")
    j = j.where(F.col("m.attachment_id").isNull() | (F.col("a.attachment_id").isNotNull() & ok("a")))
    return j.select("m.knowledge_id", "d.doc_id", "s.source_id", "s.source_name", "s.official_url", F.coalesce("a.attachment_id", F.lit("")).alias("attachment_id"), F.coalesce("a.name", F.lit("")).alias("attachment_name"), F.coalesce("a.url", F.lit("")).alias("attachment_url"), F.col("d.text").alias("content"))


def attachment_lists(resolved: DataFrame, attachments: DataFrame) -> DataFrame:
    """Admitted attachments of each resolved document, in order; without any, the mapped
    one stands in."""
    ok = F.col("rag_eligible") & ~F.col("pii_detected") & (F.col("review_status") == "ACCEPTED")
    g = attachments.where(ok).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "attachment_id"))), lambda x: x["attachment_id"]).alias("list"))
    own = F.when(F.col("attachment_id") != "", F.array("attachment_id")).otherwise(F.array().cast("array<string>"))
    return resolved.join(g, "doc_id", "left").select("knowledge_id", "doc_id", F.coalesce("list", own).alias("attachments"))


def evidence(candidates: DataFrame, resolved: DataFrame, domains: list[str], top: int, school: str) -> DataFrame:
    """candidates: query_id, ord, knowledge_id, chunk_id, content. Blank ones go, the catalog
    joins in, URLs are checked, and the first `top` of each query by ord stay: ranked after
    the join, so that a candidate without an entry takes no place."""
    c = candidates.where((F.btrim("knowledge_id") != "") & (F.btrim("chunk_id") != "") & (F.btrim("content") != "")).drop("doc_id")
    j = c.join(resolved.drop("content"), "knowledge_id")
    url = first_present(allowed_or_empty(F.col("attachment_url"), domains), allowed_or_empty(F.col("official_url"), domains))
    j = j.withColumns({"source_url": url, "evidence_id": scoped_id("src_kb_", F.lit(school), F.col("doc_id").cast("string")), "_row": F.monotonically_increasing_id()}).where("source_url <> '' and _row >= 0").drop("_row")
    w = Window.partitionBy("query_id").orderBy("ord")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def group_sources(items: DataFrame, key: str, ord_: str, content: str, limit: int = 1200) -> DataFrame:
    """Sources in the order of their first item, with distinct excerpts in order."""
    # excerpts are made distinct before they are gathered: a list holds no repeats
    once = items.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key, truncated(content, limit).alias("_x")).agg(F.min(ord_).alias("_o"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_x"))), lambda r: r["_x"])
    return once.groupBy(key).agg(F.min("_o").alias("first_ord"), ordered.alias("excerpts"))


def merge_groups(*groups: DataFrame, key: str) -> DataFrame:
    """Ordered union of source groups (each with key and ord); the first of an id stays."""
    df = None
    for i, g in enumerate(groups):
        part = g.select(F.trim(key).alias(key), F.struct(F.lit(i).alias("grp"), "ord").alias("at"))
        df = part if df is None else df.unionByName(part)
    first = df.where(F.col(key) != "").groupBy(key).agg(F.min("at").alias("at"))
    return first.select(key, "at.grp", "at.ord")


def hybrid(knowledge: DataFrame, web: DataFrame) -> DataFrame:
    """Outcome per query (query_id, failed, n): a failed web search ends it, a failed or
    empty knowledge search doesn't, no web evidence means no answer."""
    w = web.select("query_id", F.col("failed").alias("wf"), F.col("n").alias("wn"))
    k = knowledge.select("query_id", F.col("failed").alias("kf"), F.col("n").alias("kn"))
    j = w.join(k, "query_id", "left")
    state = F.when(F.col("wf"), "web_failed").when(F.col("wn") == 0, "no_answer").when(F.coalesce(F.col("kf"), F.lit(True)), "web_only").when(F.col("kn") == 0, "web_only").otherwise("both")
    return j.select("query_id", state.alias("outcome"))


def query_terms(question: Column, most: int = 12) -> Column:
    """The whole question, its words, and the bigrams of long words until there are
    `most`; distinct, in order, two characters at least."""
    q = F.lower(F.btrim(question))
    words = F.filter(F.split(q, r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def add(acc: Column, term: Column) -> Column:
        return F.when((F.char_length(term) < 2) | F.array_contains(acc, term), acc).otherwise(F.concat(acc, F.array(term)))

    def word(acc: Column, w: Column) -> Column:
        n = F.char_length(w)
        pieces = F.when(n > 4, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.aggregate(pieces, add(acc, w), lambda a, t: F.when(F.size(a) >= most, a).otherwise(add(a, t)))

    start = F.when(F.char_length(q) >= 2, F.array(q)).otherwise(F.array().cast("array<string>"))
    return F.aggregate(words, start, word)


def occurrences(text: Column, term: Column) -> Column:
    return F.when(term == "", 0).otherwise((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("long")


def relevance(text: Column, terms: Column, whole: int = 8) -> Column:
    """Sum of the terms' counts; the first (the whole question) weighs more."""
    scored = F.transform(terms, lambda t, i: occurrences(text, t) * F.when(i == 0, whole).otherwise(1))
    return F.aggregate(scored, F.lit(0).cast("long"), lambda a, x: a + x)


def section_topk(sections: DataFrame, key: str, k: int = 3, budget: int = 1200, shortest: int = 8) -> DataFrame:
    """The k best sections (key, ord, text, score) of each key, ties in order, then as much
    of them as the budget of characters allows; the last may be cut."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    top = sections.where(F.char_length("text") >= shortest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    before = F.coalesce(F.sum(F.char_length("text")).over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("left", F.lit(budget) - before).where(F.col("left") > 0).withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("left").cast("int"))).drop("left")


def citations(candidates: DataFrame, run: str = "query_id") -> DataFrame:
    """candidates: run, ord, source_id, document_id, knowledge_id, chunk_id, title, text,
    three URLs. Valid ones (source, title, evidence and a public URL), the first of each
    identity, numbered in order, with an id from the identity."""
    c = candidates.withColumns({"source_id": F.btrim("source_id"), "title": F.btrim("title"), "evidence_text": truncated(F.btrim("text"), 1200, ""), **{u: public_or_empty(F.col(u)) for u in ("attachment_url", "official_url", "parent_url")}, "_row": F.monotonically_increasing_id()})
    # the id keeps the filter above the projection, so that URLs are taken apart once
    c = c.where((F.col("_row") >= 0) & (F.col("source_id") != "") & (F.col("title") != "") & (F.col("evidence_text") != "") & (first_present("attachment_url", "official_url", "parent_url") != ""))
    parts = ["source_id", "document_id", "knowledge_id", "chunk_id"]
    first = c.withColumn("_n", F.row_number().over(Window.partitionBy(run, *parts).orderBy("ord"))).where("_n = 1").drop("_n", "_row")
    index = F.row_number().over(Window.partitionBy(run).orderBy("ord"))
    return first.withColumns({"index": index, "citation_id": scoped_id("cit_", *parts)})


def grounding(items: DataFrame, run: str, limit: int = 1800) -> DataFrame:
    """Numbered evidence of each run as one text."""
    body = F.concat(F.lit("Evidence "), F.col("index").cast("string"), F.lit(": "), first_present("title", F.lit("untitled")), F.lit("\n"), truncated(F.btrim("content"), limit))
    return items.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("material"))


def cacheable(answers: DataFrame, cites: DataFrame, key: str) -> DataFrame:
    """Whether an answer may be cached: it has citations, all official and with a URL, and
    their numbers are 1 to n."""
    g = cites.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), F.max("index").alias("hi"), F.min("index").alias("lo"), F.min(F.col("official") & (F.col("url") != "")).alias("ok"))
    ok = F.col("ok") & (F.col("n") == F.col("d")) & (F.col("hi") == F.col("n")) & (F.col("lo") == 1)
    return answers.join(g, key, "left").select(key, F.coalesce(ok, F.lit(False)).alias("cacheable"))


def metadata_text(json: Column | str, keys: list[str], default: str | None = None) -> Column:
    """The first of the keys of a JSON object that has a text that isn't blank; strings come
    out without white space at their ends, other values as they are written."""
    return F.coalesce(*[F.nullif(canonical_ends(F.get_json_object(json, f"$.{k}")), F.lit("")) for k in keys], F.lit(default))


def metadata_long(json: Column | str, keys: list[str], default: int | None = None) -> Column:
    """The first of the keys of a JSON object that holds a whole number."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}").try_cast("long") for k in keys], F.lit(default).cast("long"))
