"""Candidates of pages whose numbers repeat or are missing: one row for each page, as in SQL."""

from __future__ import annotations

import duckdb
from conftest import normal

from tessera.queries import ORACLE_SQL, QUERIES


def test_repeated_and_missing_numbers_keep_their_pages(spark, tmp_path):
    html = "<title>{0}</title><h1>{0}</h1><article><p>text</p></article>"
    titles = [(7, "Parent title"), (73, "No"), (73, "Second of two"), (8, "Eighth page"), (8, "Eighth again"), (8, "Eighth once more"), (None, "Without number"), (81, "x"), (9, "no")]
    pages = [(k, f"http://h.example/{i}", html.format(x)) for i, (k, x) in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(k,) for k in (7, 73, 8, 81, 9)], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["candidates"](spark, str(tmp_path))
    want = c.execute(ORACLE_SQL["candidates"])
    columns = [d[0] for d in want.description]
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == normal(want.fetchall(), columns)
    assert len({r[-1] for r in got}) == len(pages)
