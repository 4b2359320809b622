"""Grounding material has up to 1800 characters of each evidence."""

from __future__ import annotations

from conftest import DATA, normal

from tessera.queries import ORACLE_SQL, QUERIES


def test_grounding_equals_sql_with_the_production_limit(spark, duck):
    df = QUERIES["grounding_text"](spark, DATA)
    sql = ORACLE_SQL["grounding_text"].replace("left(trim(d.text), 20)", "left(trim(d.text), 1800)").replace("length(trim(d.text)) > 20", "length(trim(d.text)) > 1800")
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)
