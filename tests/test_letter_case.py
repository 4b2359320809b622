"""Patterns that ignore case do so for all letters, as their SQL does."""

from __future__ import annotations

import duckdb
import pytest
from conftest import normal
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.queries import ORACLE_SQL, QUERIES

PATTERNS = ["ción", "licen[cs]e", r"version \d", "worthless|idiot", "token", "andthe|ofthe", "desle", "i+x?", "(?:a|[h-j])z", "straße", "μ"]
TEXTS = ["ACCIÓN", "acción", "CIón", "LICENſE", "licence", "licence", "toKen", "TOKEN", "ıdiot", "İDIOT", "IDIOT", "worthleſs", "VERSİON 1", "VERSION 1", "DEſLE", "iII", "ıx", "Iz", "ız", "STRASSE", "STRAẞE", "µ", "Μ", ""]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_case_of_all_letters(spark, pattern):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    got = [r[0] for r in rows.select(F.col("x").rlike(X.ignoring_case(pattern, "s"))).collect()]
    assert got == [duckdb.execute("SELECT regexp_matches(?, ?)", [t, f"(?is){pattern}"]).fetchone()[0] for t in TEXTS]


def test_negated_classes_are_refused():
    with pytest.raises(ValueError, match="negated"):
        X.ignoring_case("[^a]b")


@pytest.mark.parametrize("name", ["evidence_tags", "reason_counts", "rejection_reasons", "topic_assign", "accept_split"])
def test_queries_over_capital_letters(name, spark, tmp_path):
    """Titles that give each topic, over texts whose evidence is in capitals or in letters
    that fold to a-z."""
    heads = ["delos", "DELOS", "the license", "LICENſE", "derund", "leslade", "DEſLE", "forthe"]
    bodies = ["nada", "LA ACCIÓN", "la acción", "licenſe", "TOKEN", "ıdiot", "IDIOT", "UND DER", "BUREAU", "VERSİON 1"]
    rows = [(i, f"{h}\n{b} " + "x" * 120, 121 + len(h) + len(b) + 1, f"src{i % 7}", "es") for i, (h, b) in enumerate((h, b) for h in heads for b in bodies)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    got = normal([tuple(r) for r in df.collect()], df.columns)
    want = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert got == normal(want.fetchall(), columns)
