"""Joins of op11 send nothing to the driver, however small Spark takes their sides to be."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import spelling
from tessera.llm.common import settle


def test_exploded_rows_are_not_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        letters = F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "ghijklmnop")
        words = settle(spark.range(2000).select(F.substring(letters, 1, 6).alias("word"), F.lit(5).cast("long").alias("n")))
        near = spelling.near_words(words)
        near.collect()
        assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
        docs = spark.createDataFrame([(1, "running " * 60 + "runing " * 6 + "runnings " * 6)], "doc_id long, text string")
        found = spelling.variants(docs)
        assert {(r.word, r.form) for r in found.collect()} == {("running", None), ("runing", "running"), ("runnings", "running")}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
