"""op8 drops a line that stands in two documents."""

from __future__ import annotations

from test_corpus_operators import frame

from tessera.llm.queries import QUERIES


def test_op8_line_in_two_documents(spark, tmp_path):
    line = "this very line stands in two documents"
    frame(spark, [(1, f"alpha one\n{line}"), (2, f"beta two\n{line}\ngamma three"), (3, "delta four")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["op8_template_tree"](spark, str(tmp_path)).collect()}
    assert got == {1: f"alpha one\n{line}", 2: "beta two\ngamma three", 3: "delta four"}
