"""Timetables: week bitmaps, islands, interval partitioning, the academic calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .folds import fold

LONGEST = 64


def week_bitmap(bits: Column) -> Column:
    """Weeks (from 1) whose bit is set; null for other characters or over 64 bits."""
    ok = bits.rlike("^[01]*$") & (F.char_length(bits) <= LONGEST)
    weeks = F.filter(F.transform(F.split(bits, ""), lambda c, i: F.when(c == "1", i + 1)), lambda x: x.isNotNull())
    return F.when(ok, weeks)


def normalise(rows: DataFrame, sections: int = 16) -> DataFrame:
    """Rows with name, teacher, room, weekday, start, end, bits (strings) and ord: valid
    courses, the first of equal ones, and a flag on rows that are skipped or repeated."""
    clean = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    num = lambda c: F.btrim(F.col(c)).try_cast("int")
    r = rows.select("ord", clean("name").alias("name"), clean("teacher").alias("teacher"), clean("room").alias("room"), num("weekday").alias("weekday"), num("start").alias("start"), num("end").alias("end"), week_bitmap(F.col("bits")).alias("weeks"))
    ok = (F.col("name") != "") & F.greatest(*[F.char_length(c) for c in ("name", "teacher", "room")]).between(1, 200) & (F.size("weeks") > 0) & F.col("weekday").between(1, 7) & (F.col("start") >= 1) & (F.col("end") <= sections) & (F.col("end") >= F.col("start"))
    r = r.withColumn("ok", F.coalesce(ok, F.lit(False)))
    first = F.min("ord").over(Window.partitionBy("name", "teacher", "room", "weekday", "start", "end", "weeks", "ok"))
    return r.withColumn("state", F.when(~F.col("ok"), "skipped").when(F.col("ord") == first, "kept").otherwise("repeated")).drop("ok")


def week_label(weeks: Column) -> Column:
    """Text of a list of weeks: ranges of neighbours, first to last with odd or even if they go
    in steps of two (three or more), or that there are none. Order and repeats don't matter."""
    return let(F.array_sort(F.array_distinct(weeks)), _label)


def _label(s: Column) -> Column:
    n = F.size(s)
    inner = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i > 0)
    steps = F.forall(inner, lambda i: F.get(s, i) == F.get(s, i - 1) + 2)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1) + 1))
    first, last = F.get(s, 0), F.get(s, n - 1)

    def ranges(starts: Column) -> Column:
        def written(at: Column, k: Column) -> Column:
            a, b = F.get(s, at), F.get(s, F.coalesce(F.get(starts, k + 1), n) - 1)
            return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("–", a.cast("string"), b.cast("string")))

        return F.array_join(F.transform(starts, written), "、")

    odd = F.concat(F.concat_ws("–", first.cast("string"), last.cast("string")), F.lit("周（"), F.when(first % 2 == 1, "单").otherwise("双"), F.lit("）"))
    return F.when(n == 0, "无上课周次").when((n >= 3) & steps, odd).otherwise(F.concat(let(starts, ranges), F.lit("周")))


def week_ranges(weeks: DataFrame, key: str) -> DataFrame:
    """weeks: key, week. The label of each key's weeks; a key has few (LONGEST at most)."""
    return weeks.groupBy(key).agg(week_label(F.collect_set("week")).alias("label"))


def overlap_groups(courses: DataFrame, day: str) -> DataFrame:
    """Courses (day, id, start, end) with the number of their group: a course that starts
    after all earlier ones ended opens a new one."""
    w = Window.partitionBy(day).orderBy("start", "end", "id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > before, F.lit(True))
    return courses.withColumn("new", new.cast("int")).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def lanes(courses: DataFrame, day: str) -> DataFrame:
    """Lowest free lane of each course in its group and the lanes of the group. Groups are
    told apart natively; only the greedy choice runs as an ordered fold."""
    def step(ends: list, row: tuple) -> int:
        lane = next((i for i, e in enumerate(ends) if e < row[2]), len(ends))
        ends[lane : lane + 1] = [row[3]]
        return lane

    g = overlap_groups(courses.select(F.col(day).alias("day"), "id", "start", "end"), "day")
    f = fold(g, ["day", "grp"], ["start", "end", "id"], list, step, "lane", "int")
    return f.withColumn("lane_count", F.max("lane").over(Window.partitionBy("day", "grp")) + 1)


def academic_week(day: Column, term_start: Column) -> Column:
    """Week of the term (1 is the week of its first day); not clamped."""
    monday = F.date_sub(term_start, F.weekday(term_start))
    return (F.floor(F.datediff(day, monday) / 7) + 1).cast("long")


def week_monday(term_start: Column, week: Column) -> Column:
    return F.date_add(F.date_sub(term_start, F.weekday(term_start)), (week - 1) * 7)


def snapshot_faults(rows: DataFrame, snapshot: str, id_: str, source: str, start: Column, end: Column, last: int) -> DataFrame:
    """For each snapshot: ids that repeat, whether its rows are of several sources, and rows
    whose sections don't lie in order within 1 to `last`. A snapshot without faults is valid."""
    fine = F.coalesce((start >= 1) & (start <= end) & (end <= last), F.lit(False))
    by_id = rows.groupBy(snapshot, id_).agg(F.count("*").alias("_n"), F.min(source).alias("_a"), F.max(source).alias("_b"), F.count_if(~fine).alias("_bad"))
    g = by_id.groupBy(snapshot).agg((F.sum("_n") - F.count("*")).alias("repeated_ids"), (F.min("_a") != F.max("_b")).alias("mixed_source"), F.sum("_bad").alias("out_of_range"))
    return g.withColumn("valid", (F.col("repeated_ids") == 0) & ~F.col("mixed_source") & (F.col("out_of_range") == 0))
