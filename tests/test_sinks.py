"""Versioned tables, the document store and raw landing, with failures on the way."""

from __future__ import annotations

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks as S
from tessera.sources import versioned as V

ROW = "id long, digest string, n long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, tmp_path, n=100):
    path = str(tmp_path / "t")
    V.create(spark.createDataFrame([(i, f"d{i}", i) for i in range(n)], ROW), path, ["id"], buckets=8, batch="first")
    return path


def folders(path):
    return sorted(os.listdir(f"{path}/data"))


def test_upserts_make_versions_and_old_ones_stay(spark, tmp_path):
    path = table(spark, tmp_path)
    new = spark.createDataFrame([(5, "x", -5), (200, "y", 200)], ROW)
    assert V.upsert(new, path) == 2
    assert rows(V.read(spark, path, 1)) == [(i, f"d{i}", i) for i in range(100)]
    assert rows(V.read(spark, path)) == sorted([(i, f"d{i}", i) for i in range(100) if i != 5] + [(5, "x", -5), (200, "y", 200)])
    # buckets without a changed key are the files of the first version
    one, two = V.manifest(spark, path, 1), V.manifest(spark, path, 2)
    assert sum(one["buckets"].get(b) != p for b, p in two["buckets"].items()) <= 2
    assert V.upsert(new.withColumn("n", F.lit(0).cast("long")), path, how="keep") == 3
    assert rows(V.read(spark, path)) == rows(V.read(spark, path, 2))
    assert V.upsert(spark.createDataFrame([(5, "x", 77), (6, "other", 77)], ROW), path, how="guard", guard="digest") == 4
    assert {r.id: r.n for r in V.read(spark, path).where("id in (5, 6)").collect()} == {5: 77, 6: 6}


def test_of_two_writers_one_loses(spark, tmp_path):
    path = table(spark, tmp_path)
    first, second = spark.createDataFrame([(1, "a", 1)], ROW), spark.createDataFrame([(1, "b", 2)], ROW)
    assert V.upsert(first, path, based_on=1) == 2
    before = folders(path)
    with pytest.raises(V.Conflict):
        V.upsert(second, path, based_on=1)
    assert folders(path) == before and V.versions(spark, path) == [1, 2]
    assert rows(V.read(spark, path).where("id = 1")) == [(1, "a", 1)]


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    path = table(spark, tmp_path)
    new = spark.createDataFrame([(300, "a", 1)], ROW)
    assert V.upsert(new, path, batch="b1") == 2 and V.upsert(spark.createDataFrame([(301, "a", 1)], ROW), path, batch="b2") == 3
    assert V.upsert(new, path, batch="b1") == 2 and V.versions(spark, path) == [1, 2, 3]


@pytest.mark.parametrize("how", ["twice", "check", "columns"])
def test_a_refused_upsert_leaves_no_version_and_no_files(spark, tmp_path, how):
    path = table(spark, tmp_path)
    before = folders(path)

    def refuse(written):
        raise ValueError("mapping_count_mismatch")

    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2)] if how == "twice" else [(1, "a", 1)], ROW)
    with pytest.raises(Exception, match={"twice": "key_not_unique", "check": "mapping_count", "columns": "columns of"}[how]):
        V.upsert(new.drop("n") if how == "columns" else new, path, check=refuse if how == "check" else None)
    assert folders(path) == before and V.versions(spark, path) == [1] and V.read(spark, path).count() == 100


def test_a_writer_that_dies_before_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    path = table(spark, tmp_path)

    def die(*_):
        raise KeyboardInterrupt

    new = spark.createDataFrame([(1, "a", 1), (500, "a", 1)], ROW)
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            V.upsert(new, path, batch="b")
    assert len(folders(path)) == 2 and V.read(spark, path).count() == 100
    assert V.upsert(new, path, batch="b") == 2 and V.read(spark, path).count() == 101
    assert len(V.vacuum(spark, path, keep=2)) == 1 and V.read(spark, path, 1).count() == 100
    V.upsert(spark.createDataFrame([(i, "z", 0) for i in range(101)], ROW), path)
    V.vacuum(spark, path, keep=1)
    assert V.versions(spark, path) == [3] and V.read(spark, path).count() == 102


def test_empty_upserts_and_small_files(spark, tmp_path):
    path = str(tmp_path / "e")
    V.create(spark.createDataFrame([], ROW), path, ["id"], buckets=4)
    assert V.read(spark, path).count() == 0
    assert V.upsert(spark.createDataFrame([], ROW), path) == 2 and V.upsert(spark.createDataFrame([(1, None, None)], ROW), path) == 3
    assert rows(V.read(spark, path)) == [(1, None, None)]
    at = str(tmp_path / "f" / "report.json")
    V.put_file(spark, at, '{"a": 1}')
    with pytest.raises(FileExistsError):
        V.put_file(spark, at, "{}")
    V.put_file(spark, at, '{"a": "é"}', replace=True)
    assert json.loads(V.get_file(spark, at)) == {"a": "é"} and not glob.glob(f"{tmp_path}/f/*.part")


# -- document store -------------------------------------------------------------------------

DOC = "key string, digest string, item string"


def docs(spark, *pairs):
    return spark.createDataFrame([(k, d, f"text of {k}\nline") for k, d in pairs], DOC)


def test_new_documents_are_uploaded_known_ones_reused(spark, tmp_path):
    path = str(tmp_path / "kb")
    first = S.import_documents(docs(spark, ("a", "1"), ("b", "2"), ("b", "2")), path, "one")
    assert rows(first) == [("a", "upload"), ("b", "upload")]
    second = S.import_documents(docs(spark, ("b", "2"), ("c", "3")), path, "two")
    assert rows(second) == [("b", "reuse"), ("c", "upload")]
    assert rows(S.documents(spark, path).select("key", "digest")) == [("a", "1"), ("b", "2"), ("c", "3")]


@pytest.mark.parametrize("bad", [[("a", "changed"), ("z", "1")], [("y", "1"), ("y", "2")]])
def test_changed_content_fails_before_anything_is_written(spark, tmp_path, bad):
    path = str(tmp_path / "kb")
    S.import_documents(docs(spark, ("a", "1")), path, "one").collect()
    with pytest.raises(ValueError, match="different_content"):
        S.import_documents(docs(spark, *bad), path, "two")
    assert rows(S.documents(spark, path).select("key")) == [("a",)]


def save(df, path, batch):
    df.sparkSession.dataSource.register(S.DocumentStore)
    df.write.format("document_store").mode("append").option("path", path).option("batch", batch).save()


def test_a_batch_that_is_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "kb")
    for _ in range(2):
        save(docs(spark, ("a", "1"), ("b", "2")).repartition(2), path, "one")
    assert rows(S.documents(spark, path).select("key")) == [("a",), ("b",)]
    assert len(glob.glob(f"{path}/commits/*")) == 1


def test_rows_of_a_failed_write_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "kb")

    @F.udf("string")
    def fails(key):
        if key == "k9":
            raise RuntimeError("a task dies")
        return key

    some = docs(spark, *[(f"k{i}", "1") for i in range(10)]).repartition(5)
    with pytest.raises(Exception, match="a task dies"):
        save(some.withColumn("item", fails("key")), path, "one")
    assert S.documents(spark, path).count() == 0
    save(some, path, "one")
    assert S.documents(spark, path).count() == 10
    open(f"{path}/rows/stray.jsonl", "w").write('{"key": "lost attempt", "digest": "", "item": ""}\n')
    assert S.documents(spark, path).count() == 10


# -- landing --------------------------------------------------------------------------------

RAW = "url string, content binary, status int"


def test_content_lands_once_and_is_resumed(spark, tmp_path):
    raw, ledger = str(tmp_path / "raw"), str(tmp_path / "ledger")
    first = [("http://a/x.PDF?q", b"one", 200), ("http://a/y.htm", b"one", 200), ("http://a/y.pdf", b"one", 200), ("http://a/none", None, 404), ("http://a/y.htm", b"one", 200)]
    got = S.land(spark.createDataFrame(first, RAW).repartition(3), raw, ledger, (".pdf",))
    sha = hashlib.sha256(b"one").hexdigest()
    assert rows(got.select("url", "raw_file", "status").na.fill("")) == [("http://a/none", "", 404), ("http://a/x.PDF?q", f"{sha}.pdf", 200), ("http://a/y.htm", f"{sha}.html", 200), ("http://a/y.pdf", f"{sha}.pdf", 200)]
    assert sorted(os.listdir(raw)) == [f"{sha}.html", f"{sha}.pdf"]
    times = {f: os.stat(f"{raw}/{f}").st_mtime_ns for f in os.listdir(raw)}
    # half of the ledger is lost, a file is torn: the next landing mends both and adds what is new
    os.remove(sorted(glob.glob(f"{ledger}/*.parquet"))[0])
    open(f"{raw}/{sha}.html", "wb").write(b"on")
    lost = {u for u, *_ in first} - {r.url for r in spark.read.schema("url string").parquet(ledger).collect()}
    more = S.land(spark.createDataFrame([*first, ("http://a/z.pdf", b"two", 200)], RAW), raw, ledger, (".pdf",))
    assert {r.url for r in more.collect()} == lost | {"http://a/z.pdf"}
    assert {r.url for r in spark.read.schema("url string").parquet(ledger).collect()} == {u for u, *_ in first} | {"http://a/z.pdf"}
    assert os.stat(f"{raw}/{sha}.pdf").st_mtime_ns == times[f"{sha}.pdf"] and len(os.listdir(raw)) == 3
    again = S.land(spark.createDataFrame(first, RAW), raw, ledger, (".pdf",))
    assert again.count() == 0 and spark.read.schema("url string").parquet(ledger).count() == 5


def test_a_task_of_the_store_holds_one_row_at_a_time(tmp_path):
    """Writing and reading 200 items of 1 MB takes the memory of a few."""
    import tracemalloc

    options = {"path": str(tmp_path / "kb"), "batch": "one"}
    writer = S._Writer(options, type("Schema", (), {"names": ["key", "digest", "item"]})(), False)
    tracemalloc.start()
    try:
        said = writer.write({"key": str(i), "digest": "d", "item": "x" * (1 << 20)} for i in range(200))
        writer.commit([said])
        (part,) = S._Reader(options).partitions()
        assert said.rows == sum(len(item) == 1 << 20 for _, _, item in S._Reader(options).read(part)) == 200
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()
