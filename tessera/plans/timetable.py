"""Queries over timetables built from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timetable as T
from .registry import query

#: A week bitmap from the size and key of a part; some are broken.
BITS = "CASE WHEN p_partkey % 11 = 0 THEN '10x1' WHEN p_partkey % 7 = 0 THEN repeat('1', 65) WHEN p_partkey % 5 = 0 THEN repeat('10', 6) ELSE bits END"


def parts(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    bits = F.lpad(F.bin(k * 37 + s * 11), 16, "0")
    return t("part").select(k, s, "p_brand", F.when(k % 11 == 0, "10x1").when(k % 7 == 0, F.repeat(F.lit("1"), 65)).when(k % 5 == 0, F.repeat(F.lit("10"), 6)).otherwise(bits).alias("bits"))


PARTS = f"WITH p0 AS (SELECT *, lpad(bin(p_partkey * 37 + p_size * 11), 16, '0') AS bits FROM part), p AS (SELECT p_partkey, p_size, p_brand, {BITS} AS bits FROM p0), w AS (SELECT p_partkey, p_size, p_brand, CASE WHEN regexp_full_match(bits, '[01]*') AND length(bits) <= 64 THEN list_filter(range(1, length(bits) + 1), lambda i: bits[i] = '1') END AS weeks FROM p) "


@query("week_bitmap", PARTS + "SELECT p_partkey, array_to_string(weeks, ',') AS weeks FROM w")
def week_bitmap(t):
    return parts(t).select("p_partkey", F.array_join(F.transform(T.week_bitmap(F.col("bits")), lambda x: x.cast("string")), ",").alias("weeks"))


@query("course_in_week", PARTS + "SELECT p_partkey, coalesce(list_contains(weeks, 5), false) AS in_week FROM w")
def course_in_week(t):
    return parts(t).select("p_partkey", F.coalesce(F.array_contains(T.week_bitmap(F.col("bits")), 5), F.lit(False)).alias("in_week"))


@query("week_ranges", PARTS + """, e AS (SELECT p_partkey, unnest(weeks) AS week FROM w), d AS (SELECT *, week - lag(week) OVER (PARTITION BY p_partkey ORDER BY week) AS step, week - row_number() OVER (PARTITION BY p_partkey ORDER BY week) AS g FROM e),
r AS (SELECT p_partkey, g, min(week) AS a, max(week) AS b FROM d GROUP BY 1, 2), s AS (SELECT p_partkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, '、' ORDER BY a) AS plain FROM r GROUP BY 1),
q AS (SELECT p_partkey, min(week) AS lo, max(week) AS hi, count(*) AS n, min(step) AS s1, max(step) AS s2 FROM d GROUP BY 1) SELECT p_partkey, CASE WHEN n >= 3 AND s1 = 2 AND s2 = 2 THEN lo || '–' || hi || '周（' || CASE WHEN lo % 2 = 1 THEN '单' ELSE '双' END || '）' WHEN n IS NULL THEN '无上课周次' ELSE plain || '周' END AS label FROM (SELECT p_partkey FROM w WHERE weeks IS NOT NULL) LEFT JOIN s USING (p_partkey) LEFT JOIN q USING (p_partkey)""")
def week_ranges(t):
    weeks = T.week_bitmap(F.col("bits"))
    return parts(t).where(weeks.isNotNull()).select("p_partkey", T.week_label(weeks).alias("label"))


def _rows(t):
    k = F.col("p_partkey")
    return parts(t).select(k.alias("ord"), F.when(k % 13 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("name"), F.lit("t").alias("teacher"), F.lit(None).cast("string").alias("room"), (F.col("p_size") % 9).cast("string").alias("weekday"), F.when(k % 17 == 0, "one").otherwise((k % 15 + 1).cast("string")).alias("start"), (k % 15 + 1 + F.col("p_size") % 4).cast("string").alias("end"), F.when(k % 4 == 1, "0110").otherwise(F.col("bits")).alias("bits"))


@query("course_normalize", PARTS + """, r AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE trim(p_brand) END AS name, p_size % 9 AS weekday, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 15 + 1 END AS st, p_partkey % 15 + 1 + p_size % 4 AS en, CASE WHEN p_partkey % 4 = 1 THEN [2, 3] ELSE weeks END AS weeks FROM w),
k AS (SELECT *, coalesce(name <> '' AND len(weeks) > 0 AND weekday BETWEEN 1 AND 7 AND st >= 1 AND en <= 16 AND en >= st, false) AS ok FROM r)
SELECT ord, CASE WHEN NOT ok THEN 'skipped' WHEN ord = min(ord) OVER (PARTITION BY name, weekday, st, en, weeks, ok) THEN 'kept' ELSE 'repeated' END AS state FROM k""")
def course_normalize(t):
    return T.normalise(_rows(t)).select("ord", "state")


def _courses(t):
    k = F.col("l_orderkey")
    return t("lineitem").select(k.alias("day"), F.col("l_linenumber").cast("long").alias("id"), (F.pmod(F.col("l_partkey"), F.lit(12)) + 1).cast("int").alias("start"), (F.pmod(F.col("l_partkey"), F.lit(12)) + 1 + F.pmod(F.col("l_suppkey"), F.lit(4))).cast("int").alias("end"))


@query("overlap_groups", 'WITH c AS (SELECT l_orderkey AS day, l_linenumber AS id, l_partkey % 12 + 1 AS s, l_partkey % 12 + 1 + l_suppkey % 4 AS e FROM lineitem), b AS (SELECT *, max(e) OVER (PARTITION BY day ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM c) SELECT day, CAST(id AS BIGINT) AS id, CAST(sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s, e, id) AS BIGINT) AS grp FROM b')
def overlap_groups(t):
    return T.overlap_groups(_courses(t), "day").select("day", "id", "grp")


@query("lane_layout", """WITH RECURSIVE c AS (SELECT l_orderkey AS day, CAST(l_linenumber AS BIGINT) AS id, l_partkey % 12 + 1 AS s, l_partkey % 12 + 1 + l_suppkey % 4 AS e FROM lineitem),
b AS (SELECT *, max(e) OVER (PARTITION BY day ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, row_number() OVER (PARTITION BY day ORDER BY s, e, id) AS r FROM c),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s, e, id) AS grp FROM b), h AS (SELECT *, row_number() OVER (PARTITION BY day, grp ORDER BY s, e, id) AS n FROM g),
f AS (SELECT day, id, s, e, grp, n, 1 AS lane, [e] AS ends FROM h WHERE n = 1 UNION ALL
SELECT day, id, s, e, grp, n, lane, CASE WHEN lane > len(ends) THEN list_append(ends, e) ELSE list_concat(list_append(ends[1:lane - 1], e), ends[lane + 1:len(ends)]) END FROM (SELECT h.day, h.id, h.s, h.e, h.grp, h.n, f.ends, coalesce(nullif(list_position(list_transform(f.ends, lambda x: x < h.s), true), 0), len(f.ends) + 1) AS lane FROM f JOIN h ON h.day = f.day AND h.grp = f.grp AND h.n = f.n + 1))
SELECT day, id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(grp AS BIGINT) AS grp, CAST(lane - 1 AS INTEGER) AS lane, CAST(max(lane) OVER (PARTITION BY day, grp) AS INTEGER) AS lane_count FROM f""")
def lane_layout(t):
    return T.lanes(_courses(t), "day")


@query("academic_week", "SELECT o_orderkey, CAST(floor(date_diff('day', DATE '1996-01-29', CAST(o_orderdate AS DATE)) / 7.0) + 1 AS BIGINT) AS week, isodow(o_orderdate) AS weekday FROM orders")
def academic_week(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", T.academic_week(d, F.lit("1996-02-01").cast("date")).alias("week"), (F.weekday(d) + 1).cast("long").alias("weekday"))
