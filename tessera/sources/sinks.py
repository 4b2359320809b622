"""Sinks that commit: an upsert sink as a data source, and content-addressed landing."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .tables import settle


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system that every executor reaches, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(store: pafs.FileSystem, at: str, data: bytes | Iterable[bytes]) -> None:
    """Writes a file aside and renames it, so that it is there whole or not at all. What comes
    in pieces is written piece by piece."""
    aside = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(aside, buffer_size=1 << 20) as out:
            for piece in [data] if isinstance(data, bytes) else data:
                out.write(piece)
    except BaseException:
        if store.get_file_info(aside).type != pafs.FileType.NotFound:
            store.delete_file(aside)
        raise
    store.move(aside, at)


# -- upserts of documents -------------------------------------------------------------------


def import_actions(wanted: DataFrame, there: DataFrame, key: str, digest: str) -> DataFrame:
    """wanted with an action: `upload` if its key isn't there, `reuse` if it is with the same
    digest, `conflict` if it is with another one (or with none). there: key and digest."""
    known = there.select(key, F.col(digest).alias("_there"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "upload").when(F.col("_there") == F.col(digest), "reuse").otherwise("conflict")
    return wanted.join(known, key, "left").withColumn("action", action).drop("_there", "_known")


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    """Each task writes a file of its own; the commit names those of the tasks that Spark
    counts, so files of lost and repeated attempts are never read."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.batch, self.names = options["path"].rstrip("/"), options.get("batch") or uuid.uuid4().hex, schema.names
        if not {"key", "digest", "item"} <= set(self.names):
            raise ValueError("rows have key, digest and item")
        if overwrite:
            raise ValueError("this sink only appends")

    def write(self, iterator: Iterator) -> _Written:
        store, at = _store(self.path)
        store.create_dir(f"{at}/rows")
        name, n = f"{uuid.uuid4().hex}.jsonl", 0

        def lines() -> Iterator[bytes]:
            nonlocal n
            for row in iterator:
                n += 1
                yield json.dumps({"key": row["key"], "digest": row["digest"], "item": row["item"]}).encode() + b"\n"

        _put(store, f"{at}/rows/{name}", lines())
        return _Written(name, n)

    def commit(self, messages: list) -> None:
        store, at = _store(self.path)
        store.create_dir(f"{at}/commits")
        target = f"{at}/commits/{self.batch}.json"
        if store.get_file_info(target).type != pafs.FileType.NotFound:
            return self.abort(messages)  # the batch was committed before: its rows are there
        _put(store, target, json.dumps({"files": [m.file for m in messages if m and m.rows], "rows": sum(m.rows for m in messages if m)}).encode())

    def abort(self, messages: list) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{at}/rows/{m.file}").type != pafs.FileType.NotFound:
                store.delete_file(f"{at}/rows/{m.file}")


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        store, at = _store(self.path)
        found = []
        for info in store.get_file_info(pafs.FileSelector(f"{at}/commits", allow_not_found=True)):
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    found += json.loads(f.read())["files"]
        return [_File(x) for x in sorted(found)] or [_File(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, at = _store(self.path)
        with store.open_input_stream(f"{at}/rows/{partition.value}") as f:
            for line in io.TextIOWrapper(io.BufferedReader(f, 1 << 20), "utf-8", newline="\n"):
                row = json.loads(line)
                yield row["key"], row["digest"], row["item"]


class DocumentStore(DataSource):
    """df.write.format("document_store").mode("append").option("path", p).option("batch", b):
    rows key, digest, item into a folder that all executors reach. A batch appears whole with
    its commit, and once: writing it again changes nothing. spark.read.format("document_store")
    gives the rows of all commits."""

    @classmethod
    def name(cls) -> str:
        return "document_store"

    def schema(self) -> str:
        return "key string, digest string, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def documents(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(DocumentStore)
    return spark.read.format("document_store").option("path", path).load()


def import_documents(wanted: DataFrame, path: str, batch: str) -> DataFrame:
    """Brings documents (key, digest, item) into the store: new ones are uploaded, those that
    are there with the same digest reused. One that is there with another digest fails the
    import (ValueError) before anything is written. Repeated rows of a key must agree, and
    are uploaded once. Returns key and action; a batch that is retried finds all its rows."""
    spark = wanted.sparkSession
    there = settle(documents(spark, path).select("key", "digest").distinct())  # as it is before this batch
    once = wanted.groupBy("key").agg(F.min("digest").alias("digest"), F.max("digest").alias("_other"), F.min("item").alias("item"))
    torn = ~F.col("digest").eqNullSafe(F.col("_other"))
    acted = settle(import_actions(once, there, "key", "digest").withColumn("action", F.when(torn, "conflict").otherwise(F.col("action"))).drop("_other"))
    bad = acted.where("action = 'conflict'").select("key").limit(1).collect()
    if bad:
        raise ValueError(f"different_content: {bad[0].key}")
    acted.where("action = 'upload'").select("key", "digest", "item").write.format("document_store").mode("append").option("path", path).option("batch", batch).save()
    # what was uploaded is read back: a key without a row has failed
    if not acted.select("key").join(documents(spark, path).select("key"), "key", "left_anti").isEmpty():
        raise RuntimeError("uploaded rows are missing")
    return acted.select("key", "action")


# -- raw landing ----------------------------------------------------------------------------


def land(fetched: DataFrame, path: str, ledger: str, suffixes: tuple[str, ...], default: str = ".html") -> DataFrame:
    """Lands fetched rows (url, content, further columns) whose url the ledger lacks: content
    goes to path/<sha256><suffix of the url, or default>, once however many rows have it; the
    ledger (Parquet) gets one row each: url, sha256, size, raw_file and the further columns.
    A file is written aside and renamed, so an attempt that dies leaves no half file, and one
    that runs twice writes the same; a landing that broke off is resumed by the next. Rows
    without content are noted without a file; of rows that repeat a url one lands. Returns the
    rows that were added."""
    spark = fetched.sparkSession
    known = _ledger(spark, ledger, fetched)
    rest = [c for c in fetched.columns if c not in ("url", "content")]
    new = fetched.dropDuplicates(["url"]) if known is None else fetched.dropDuplicates(["url"]).join(known.select("url"), "url", "left_anti")
    suffix = F.regexp_extract(F.lower(F.regexp_extract("url", r"^[^?#]*", 0)), r"(\.[a-z0-9]+)$", 1)
    named = new.select("url", "content", F.when(suffix.isin(*suffixes), suffix).otherwise(default).alias("_suffix"), *rest)
    kinds = ", ".join([f"url {fetched.schema['url'].dataType.simpleString()}", "sha256 string, size long, raw_file string", *[f"`{c}` {fetched.schema[c].dataType.simpleString()}" for c in rest]])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        store.create_dir(at)
        for b in stream:
            rows = []
            for content, suffix in zip(b.column("content"), b.column("_suffix").to_pylist(), strict=True):
                data = content.as_py()
                if data is None:
                    rows.append((None, None, None))
                    continue
                sha = hashlib.sha256(data).hexdigest()
                name = f"{sha}{suffix}"
                info = store.get_file_info(f"{at}/{name}")
                if info.type == pafs.FileType.NotFound or info.size != len(data):
                    _put(store, f"{at}/{name}", data)
                rows.append((sha, len(data), name))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("url"), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], *[b.column(c) for c in rest]], names=["url", "sha256", "size", "raw_file", *rest])

    landed = named.mapInArrow(run, kinds)
    landed.write.mode("append").parquet(ledger)
    now = spark.read.schema(landed.schema).parquet(ledger)
    return now if known is None else now.join(known.select("url"), "url", "left_anti")


def _ledger(spark: SparkSession, ledger: str, fetched: DataFrame) -> DataFrame | None:
    """The urls that a ledger holds now, apart from what is appended later."""
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(f"url {fetched.schema['url'].dataType.simpleString()}").parquet(ledger)

