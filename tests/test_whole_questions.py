"""Questions are judged on the whole turn."""

from __future__ import annotations

import pytest
from conftest import DATA, normal

from tessera.plans.evidence import TAIL
from tessera.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["freshness_class", "route_plan", "plan_valid", "question_strip"])
def test_equals_sql_without_the_cut(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    sql = ORACLE_SQL[name]
    assert TAIL in sql
    want = duck.execute(sql.replace(TAIL, r"regexp_replace(text, '\s+', ' ', 'g')"))
    columns = [d[0] for d in want.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)
