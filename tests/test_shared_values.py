"""Values that an expression uses several times are computed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import timetable as T


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weeks_are_sorted_once(spark):
    df = spark.range(3).select(F.repeat(F.lit("01"), F.col("id").cast("int")).alias("bits")).select(T.week_label(T.week_bitmap(F.col("bits"))).alias("l"))
    assert optimized(df).count("array_sort") <= 2 and optimized(df).count("array_distinct") <= 2


def test_quotes_make_the_canonical_text_once(spark):
    df = spark.createDataFrame([("a the  b o f c",), (None,)], "x string")
    got = df.select(X.quote_span("x", F.lit("the"), F.lit("o f")).alias("q"), X.evidence_window("x", F.lit("b"), 2).alias("w"))
    assert [tuple(r) for r in got.collect()] == [("the b o f", "e b o"), (None, None)]
    one = optimized(df.select(X.quote_span("x", F.lit("the"), F.lit("o f")).alias("q")))
    assert one.count("trim(") <= 2 and one.count("regexp_extract") <= 2
