"""Tables that change by whole versions: copy-on-write files under manifests.

A table is a folder with data/ and versions/. A version is one small JSON file that lists, for
each bucket of the key, the folder of its rows; it appears by a rename that fails if the name
is taken. So readers see a version whole or not at all, of two writers that start from the
same version one loses, and a writer that dies leaves files that no version names. An upsert
rewrites only the buckets that its keys fall into; the others are named again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import upsert as guarded


class Conflict(RuntimeError):
    """Another writer made the version that this one was to make."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_file(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Writes a small file so that readers see it whole or not at all. Unless it may replace
    one, FileExistsError is raised if there is one of that name."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs, at = _files(spark, path)
    fs.mkdirs(at.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1 if replace else 0)
    if replace:
        options[0] = rename.valueOf("OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(at), options)
    except Exception as error:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(error):
            raise FileExistsError(path) from None
        raise


def get_file(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version holds; the latest one by default."""
    if version is None:
        known = versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no version of {path}")
        version = known[-1]
    return json.loads(get_file(spark, f"{path}/versions/{version}.json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version; the latest one by default."""
    m = manifest(spark, path, version)
    return _rows(spark, path, m, m["buckets"])


def _rows(spark: SparkSession, path: str, m: dict, buckets: dict | list) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    paths = [f"{path}/data/{m['buckets'][b]}" for b in buckets if b in m["buckets"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(spark: SparkSession, path: str, df: DataFrame, key: list[str], buckets: int) -> tuple[str, dict[str, str]]:
    """Writes rows by bucket into a folder of their own; the folder of each bucket."""
    name = uuid.uuid4().hex
    at = f"{path}/data/{name}"
    df.withColumn("_bucket", bucket(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(at)
    fs, p = _files(spark, at)
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return name, {n.split("=")[1]: f"{name}/{n}" for n in found if n.startswith("_bucket=")}


def _commit(spark: SparkSession, path: str, m: dict) -> int:
    try:
        put_file(spark, f"{path}/versions/{m['version']}.json", json.dumps(m))
    except FileExistsError:
        fs, at = _files(spark, f"{path}/data/{m['written']}")
        fs.delete(at, True)
        raise Conflict(f"version {m['version']} of {path} was made by another writer") from None
    return m["version"]


def create(df: DataFrame, path: str, key: list[str], buckets: int = 64, batch: str | None = None) -> int:
    """Makes the first version of a table with one row for each key."""
    spark = df.sparkSession
    name, held = _write(spark, path, df, key, buckets)
    _unique(spark.read.schema(df.schema).parquet(f"{path}/data/{name}"), key)
    return _commit(spark, path, {"version": 1, "schema": json.loads(df.schema.json()), "key": key, "count": buckets, "buckets": held, "batch": batch, "written": name})


def _unique(rows: DataFrame, key: list[str]) -> None:
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"key_not_unique: {twice[0].asDict()}")


def upsert(new: DataFrame, path: str, how: str = "update", guard: str | None = None, batch: str | None = None, check: Callable[[DataFrame], None] | None = None, based_on: int | None = None) -> int:
    """Makes the next version of a table: rows with new keys come in; known ones are replaced
    (`update`), stay (`keep`), or take what the new row states where the column `guard` is the
    same (`guard`). Before the version appears, the written rows are counted: every new key
    must be there, and each key once (ValueError otherwise); `check` may refuse them by raising.
    batch: a name; a batch that any version carries changes nothing, so it may be retried.
    based_on: the version that the writer read (the latest by default); Conflict is raised if
    another one came after it. Returns the version. Columns are those of the table."""
    spark = new.sparkSession
    known = versions(spark, path)
    if batch is not None:
        for v in reversed(known):
            if manifest(spark, path, v).get("batch") == batch:
                return v
    m = manifest(spark, path, based_on)
    key, schema = m["key"], T.StructType.fromJson(m["schema"])
    if sorted(new.columns) != sorted(schema.names):
        raise AnalysisException(f"columns of {path} are {schema.names}, not {new.columns}")
    new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    touched = [str(r[0]) for r in new.select(bucket(key, m["count"])).distinct().collect()]  # at most count
    old = _rows(spark, path, m, touched)
    if how == "guard":
        if len(key) != 1 or not guard:
            raise ValueError("a guarded upsert has one key column and a guard")
        merged = guarded(old, new, key[0], guard)
    else:
        first, second = (new, old) if how == "update" else (old, new)
        merged = first.unionByName(second.join(first.select(*key), key, "left_anti"))
    name, held = _write(spark, path, merged.select(*schema.names), key, m["count"])
    fs, at = _files(spark, f"{path}/data/{name}")
    try:
        written = spark.read.schema(schema).parquet(*[f"{path}/data/{p}" for p in held.values()]) if held else spark.createDataFrame([], schema)
        _unique(written, key)
        missing = new.select(*key).join(written.select(*key), key, "left_anti").limit(1).count()
        if missing:
            raise ValueError("row_count_mismatch")
        if check:
            check(written)
    except Exception:
        fs.delete(at, True)
        raise
    buckets = {b: p for b, p in m["buckets"].items() if b not in touched} | held
    return _commit(spark, path, {**m, "version": m["version"] + 1, "buckets": buckets, "batch": batch, "written": name})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all but the last `keep` versions and the files that none of these names; the
    names of the folders removed. Not to be run while a writer is at work."""
    known = versions(spark, path)
    used = {p.split("/")[0] for v in known[-keep:] for p in manifest(spark, path, v)["buckets"].values()}
    for v in known[:-keep]:
        fs, at = _files(spark, f"{path}/versions/{v}.json")
        fs.delete(at, False)
    fs, at = _files(spark, f"{path}/data")
    gone = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() not in used]
    for name in gone:
        fs.delete(_files(spark, f"{path}/data/{name}")[1], True)
    return sorted(gone)
