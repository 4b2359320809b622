"""Rule tables, classification, personal-data detection, quality flags.

A rule is (name, pattern): rule sets are data, so the same operators serve any language.
Ordered rules become CASE chains of literal patterns, which are compiled once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import SPACE, any_of, canonical_text, compact, first_match, ignoring_case

Rules = list[tuple[str, str]]

#: The shapes that a text or a title is tested for, in the language of the
#: campus documents.
ROLE_RULES: Rules = [
    ("NON_STUDENT", "采购|招标|中标|成交公告|教职工|教师招聘|人才招聘|成员招聘|先进工作者|慰问信|教研项目|教学成果奖|开放课题|软件正版化检查|楼宇网络建设规范"),
    ("RESULT_ANNOUNCEMENT", "名单|结果公示|结果公布|评选结果|审核结果|拟录取"),
    ("FORM_TEMPLATE", "申请表|审批表|承诺书|推荐书|登记表|汇总表|空白表|模板"),
    ("NEWS", "召开|顺利举行|顺利举办|慰问|风采|事迹|述职|调研|座谈会|主题教育|新闻"),
    ("POLICY_REGULATION", "办法|细则|规定|条例|章程|规范|工作方案|实施方案"),
    ("PROCEDURE_GUIDE", "指南|办理|查询|操作说明|服务"),
    ("ANNUAL_NOTICE", "通知|安排|公告|招生简章"),
    ("PROGRAM_PLAN", "培养方案|培养计划"),
    ("APPLICATION_MATERIAL", "目录"),
]
NEWS_EXEMPT = "关于.{0,30}(报名|申请|考试|选课|推免|转专业)"
ROSTER_TITLE = "名单|花名册|成绩单|成绩表|成绩汇总|排名表|录取名单|获评名单|公示名单"
STUDENT_ID_WORDS = ["学号", "考生号", "学籍号", "校园卡号", "一卡通号"]
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CHECK = "10X98765432"


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike((f"(?{flags})" if flags else "") + pattern)


def content_role(title: Column, rules: Rules = ROLE_RULES, news_exempt: str = NEWS_EXEMPT) -> Column:
    """The first rule that a title (without white space) meets; news about an
    application, examination or the like isn't news."""
    head = compact(title)
    tests = [(n, matches(head, p) & ~matches(head, news_exempt) if n == "NEWS" else matches(head, p)) for n, p in rules]
    return first_match(tests, "UNKNOWN")


def topic(df: DataFrame, title: str, text: str, role: str, rules: Rules, intro: int = 1800, skip: tuple[str, ...] = ("NEWS", "NON_STUDENT", "RESULT_ANNOUNCEMENT"), hits: str | None = None) -> DataFrame:
    """Adds topic, origin and several: the first rule met by the title; without any, by
    the start of the text unless the role rules that out; `several` if more than one was met,
    and under the name `hits`, if given, all that were. Title and start are columns of their
    own before the rules are tried, so each is made once and only where it is needed."""
    names = lambda c: F.array_compact(F.array(*[F.when(F.col(c).rlike(ignoring_case(p)), F.lit(n)) for n, p in rules]))
    df = df.withColumn("_head", compact(F.col(title))).withColumn("_t", names("_head"))
    wanted = (F.size("_t") == 0) & ~F.coalesce(F.col(role).isin(*skip), F.lit(False))
    df = df.withColumn("_intro", F.when(wanted, compact(F.substring(canonical_text(text), 1, intro))))
    df = df.withColumn("_h", F.when(F.col("_intro").isNotNull(), names("_intro")).otherwise(F.col("_t")))
    out = df.withColumns({"topic": F.coalesce(F.try_element_at("_h", F.lit(1)), F.lit("other")), "origin": F.when(F.size("_t") > 0, "title").otherwise("body_intro"), "several": F.size("_h") > 1} | ({hits: F.col("_h")} if hits else {}))
    return out.drop("_head", "_intro", "_t", "_h")


def audience(topic_: Column, role: Column, text: Column, under: str, grad: str, undergraduate_topics: list[str]) -> Column:
    u, g = matches(text, under), matches(text, grad)
    return F.when(role == "NON_STUDENT", "TEACHER").when(topic_.isin(undergraduate_topics), "UNDERGRADUATE").when(u & g, "ALL").when(u, "UNDERGRADUATE").when(g, "GRADUATE").otherwise("UNKNOWN")


def last_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """Name of the last rule that holds (each overrides those before it)."""
    return first_match(rules[::-1], default)


def flags(*rules: tuple[str, Column]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))))


def id_cards(text: Column) -> Column:
    """National ids in a text whose check digit is right (ISO 7064, modulus 11)."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)([1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?!\d)"), F.lit(1))

    def sound(c: Column) -> Column:
        total = reduce(lambda a, b: a + b, [F.substring(c, i + 1, 1).cast("int") * w for i, w in enumerate(ID_WEIGHTS)])
        check = F.substring(F.lit(ID_CHECK), F.pmod(total, F.lit(11)) + 1, F.lit(1))
        return check == F.upper(F.substring(c, 18, 1))

    return F.filter(found, sound)


def public_contact(text: Column, phone: str) -> Column:
    """Whether a text has both an e-mail address and a telephone number."""
    return matches(text, r"[A-Za-z0-9._]+@[a-z0-9]+\.") & matches(text, phone)


def student_ids(text: Column, words: list[str] = STUDENT_ID_WORDS, digits: str = "{8,20}") -> Column:
    """How often a word for a student number is followed by 8 to 20 digits."""
    return F.regexp_count(text, F.lit(f"(?:{'|'.join(words)}){SPACE.replace('(?U)', '')}*[:：]?{SPACE.replace('(?U)', '')}*\\d{digits}")).cast("long")


def mobiles(text: Column, pattern: str = r"(?<!\d)1[3-9]\d{9}(?!\d)") -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def pii(df: DataFrame, text: str, title: str, *, mobile: str = r"(?<!\d)1[3-9]\d{9}(?!\d)", id_words: list[str] = STUDENT_ID_WORDS, roster: str = ROSTER_TITLE, name_row: str = r"(?m)^[ \t]*[一-龥]{2,4}[ \t]*[|,，\t　 ]+[ \t]*[一-龥\w]{2,20}[ \t]*[|,，\t　 ]+[ \t]*\d{6,}") -> DataFrame:
    """Adds pii_categories (sorted), pii_count and pii_risk. Mobile numbers count from
    three on, or beside student numbers or under the title of a roster."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_id": F.size(id_cards(t)).cast("long"), "_st": student_ids(t, id_words), "_mo": mobiles(t, mobile), "_na": F.regexp_count(t, F.lit(name_row)).cast("long")})
    many = (F.col("_mo") >= 3) | ((F.col("_mo") > 0) & ((F.col("_st") > 0) | matches(F.col(title), roster)))
    cats = flags(("id_card", F.col("_id") > 0), ("student_id", F.col("_st") > 0), ("mobile", many), ("student_roster", F.col("_na") >= 3))
    n = F.col("_id") + F.col("_st") + F.when(many, F.col("_mo")).otherwise(0) + F.when(F.col("_na") >= 3, F.col("_na")).otherwise(0)
    df = df.withColumns({"pii_categories": cats, "pii_count": n, "_many": many})
    strong = F.arrays_overlap("pii_categories", F.array(*[F.lit(x) for x in ("id_card", "student_id", "student_roster", "personal_score")]))
    risk = F.when(F.size("pii_categories") == 0, "NONE").when(strong | (F.col("_many") & (F.col("_mo") >= 5)), "HIGH").otherwise("MEDIUM")
    return df.withColumn("pii_risk", risk).drop("_id", "_st", "_mo", "_na", "_many")


def infer_by_list(title: Column, names: list[str]) -> Column:
    """The first listed name that the title contains."""
    return first_match([(n, title.contains(n)) for n in names], None)


def version_status(document_type: Column, published: Column, latest: Column) -> Column:
    """Regulations and guides without a date, then what is the latest seen, else history."""
    return F.when(document_type.isin("regulation", "guide") & (F.coalesce(published, F.lit("")) == ""), "current_unverified_date").when(latest, "latest_observed").otherwise("historical")


def answer_scope(college: Column, document_type: Column) -> Column:
    return F.when(F.coalesce(college, F.lit("")) != "", "COLLEGE_ONLY").when(document_type.isin("regulation", "guide"), "TIMELESS_POLICY").otherwise("DATED_SOURCE_ONLY")


def labels(text: Column, rules: Rules) -> Column:
    """All rules that the text meets, in their order."""
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(n)) for n, p in rules]))


def authority(level: Column) -> Column:
    return F.when(level.contains("college"), "OFFICIAL_COLLEGE").when(level.contains("policy"), "OFFICIAL_SCHOOL").otherwise("OFFICIAL_DEPARTMENT")


def question_route(mode: Column, routes: dict[str, str]) -> Column:
    return first_match([(v, mode == k) for k, v in routes.items()], "MANUAL_REVIEW")


def rewritten(df: DataFrame, rules: list[tuple[Column, dict[str, str]]]) -> DataFrame:
    """Sets columns where a condition holds; the first condition that holds counts."""
    names = {c for _, sets in rules for c in sets}
    out = {}
    for c in sorted(names):
        e = None
        for test, sets in rules:
            value = F.lit(sets[c]) if c in sets else F.col(c)
            e = F.when(test, value) if e is None else e.when(test, value)
        out[c] = e.otherwise(F.col(c))
    return df.withColumns(out)


def document_type(title: Column, patterns: dict[str, str], attachment: Column) -> Column:
    """The kind of a document by its title, where later rules override earlier ones:
    regulation, else guide, else notice; calendar; an attachment that is a notice so far is
    `attachment`; form; result. patterns: one for each kind but notice and attachment."""
    fits = lambda kind: F.coalesce(title.rlike(patterns[kind]), F.lit(False))
    first = F.when(fits("regulation"), "regulation").when(fits("guide"), "guide").otherwise("notice")
    first = F.when(fits("calendar"), "calendar").otherwise(first)
    first = F.when(F.coalesce(attachment, F.lit(False)) & (first == "notice"), "attachment").otherwise(first)
    return F.when(fits("result"), "result").when(fits("form"), "form").otherwise(first)


def source_metadata(pages: DataFrame, url: str, title: str, names: DataFrame, portal: str, portal_name: str, desks: list[tuple[str, str]], schoolwide: list[str], official: list[str], bracket: str = "^【([^】]+)】") -> DataFrame:
    """pages with source_name, department, college, scope and authority, by the first label of
    the url's host. names: label, name, kind (`college` or `department`), one row a label. On
    the host of all departments (label `portal`) the desk is told by a part of the path, else
    by what the title begins with in brackets; desks that serve the whole school have that
    scope. Labels of `official` speak for the school. An unknown label has no name."""
    label = F.split_part(U.host(url), F.lit("."), F.lit(1))
    known = names.select(F.col("label").alias("_label"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    p = pages.withColumn("_label", label).join(known, "_label", "left")
    desk = F.coalesce(*[F.when(F.contains(F.col(url), F.lit(part)), name) for part, name in desks], F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), bracket, 1), F.lit("")))
    college, here = F.col("_kind") == "college", F.col("_label") == portal
    college = F.coalesce(college, F.lit(False))
    named = F.when(college, F.col("_name")).when(here, desk).otherwise(F.col("_name"))
    return p.select(
        *pages.columns,
        F.when(~college & here, portal_name).otherwise(F.col("_name")).alias("source_name"), named.alias("department"), F.when(college, F.col("_name")).alias("college"),
        F.when(college, "college").when(here, F.when(desk.isin(schoolwide), "school")).when(F.col("_name").isNotNull(), "school").alias("scope"),
        F.when(college, "OFFICIAL_COLLEGE").when(~here & F.col("_label").isin(official), "OFFICIAL_SCHOOL").otherwise("OFFICIAL_DEPARTMENT").alias("authority"),
    )
