"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import DATA, normal

from tessera.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == normal(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(name, spark):
    QUERIES[name](spark, DATA).collect()


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
