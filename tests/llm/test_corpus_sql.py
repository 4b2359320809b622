"""Corpus queries with SQL against DuckDB; the others run over the small tables."""

from __future__ import annotations

import pytest
from conftest import DATA, normal

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == normal(want.fetchall(), columns)
