"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import hashlib

import brute
import corpus_pipeline as pipeline
import pytest
from conftest import DATA
from test_corpus_operators import CLASH, corpus, empty, frame
from test_near_copies import components

from tessera.llm import lsa, mixing
from tessera.llm.common import load, settle


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents of the awkward kind and labels for some."""
    path = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    frame(spark, rows, True).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d % 7 != 0), int(d % 11 == 0)) for d in sorted({d for d, _ in rows if d is not None})]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(df):
    return sorted(map(repr, df.collect()))


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"]


def test_each_stage_on_awkward_rows(spark, small):
    docs = load(spark, small, "documents")
    columns = docs.columns
    assert set(CLASH) <= set(columns)
    # quality: rows with a score of the threshold or more
    good = settle(pipeline.quality(spark, docs, small))
    assert good.columns == columns
    scores = lsa.score_quality(docs.select("doc_id", "text"), lsa.fit_quality(docs, load(spark, small, "labels")))
    assert good.count() == scores.where("score >= 0.3").count()
    # exact: one row of each text, on the whole table
    exact = settle(pipeline.exact(spark, docs, small))
    assert exact.columns == columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    b = brute.exact(rows)
    want = {(b[i][0], b[i][2]) for i in range(len(rows))}
    got = [(r.doc_id, hashlib.sha256("".join(brute.WORD.findall(r.text or "")).encode()).hexdigest()) for r in exact.collect()]
    assert len(got) == len(want) and set(got) == want
    # near: the rows whose id names their component; five words, similarity 0.8
    near = settle(pipeline.near(spark, exact, small))
    assert near.columns == columns
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    want = sorted(repr(d) for (d, _), c in zip(rows, components(rows)) if d == c)
    assert sorted(repr(r.doc_id) for r in near.collect()) == want
    # mix: copies by rate; the same choice again
    mixed = settle(pipeline.mix(spark, near, small))
    assert mixed.columns == columns and key(mixed) == key(pipeline.mix(spark, near, small))
    ids = {repr(r) for r in near.collect()}
    assert all(repr(r) in ids for r in mixed.collect())
    out = pipeline.tokens(spark, mixed, small)
    assert out.count() == mixed.count()


def test_mix_keeps_clean_documents(spark):
    docs, labels = load(spark, "/root/testdata/sf0.1", "documents"), load(spark, "/root/testdata/sf0.1", "labels")
    kept = {r.doc_id for r in mixing.resample(docs, labels).select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(clean & kept) > 0.97 * len(clean)
    assert len(toxic & kept) < 0.3 * len(toxic)


def test_run_equals_stages(spark):
    docs = load(spark, DATA, "documents")
    for _, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, DATA))
    assert key(pipeline.run(spark, DATA)) == key(docs)


def test_empty_documents(spark, small, tmp_path):
    import shutil

    shutil.copytree(f"{small}/labels.parquet", tmp_path / "labels.parquet")
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
