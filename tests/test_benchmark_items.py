"""Every benchmark item meets its documents, with its whole text."""

from __future__ import annotations

from tessera.queries import QUERIES


def test_all_items_and_whole_excerpts(spark, tmp_path):
    bench = [(i, f"the passage of item {i} in full") for i in range(60)]
    docs = [(i, f"before {bench[i % 60][1]} after" if i % 2 == 0 else "the passage is another") for i in range(120)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.doc_id, r.item_id) for r in QUERIES["ledger_admit"](spark, str(tmp_path)).collect()}
    assert got == {(i, i % 60) for i in range(0, 120, 2) if i != 2}
    reasons = {r.doc_id: "review_evidence_missing_or_changed" in r.reasons for r in QUERIES["review_reasons"](spark, str(tmp_path)).collect()}
    assert reasons == {i: i % 2 == 1 for i in range(120)}
