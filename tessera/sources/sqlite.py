"""Read-only scan of SQLite tables and whole-database snapshots."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def connect(path: str) -> sqlite3.Connection:
    """A connection that can't write. A file that is missing raises."""
    return sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)


def snapshot(path: str, target: str) -> str:
    """Copies the whole database as one consistent state; target must not exist and appears
    only when it is complete."""
    if os.path.exists(target):
        raise FileExistsError(target)
    part = f"{target}.part"
    source, copy = connect(path), sqlite3.connect(part)
    try:
        source.backup(copy)
    finally:
        copy.close()
        source.close()
    os.replace(part, target)
    return target


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str):
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(k in kind for k in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if "BLOB" in kind else StringType()


class _Rows(InputPartition):
    def __init__(self, first: int | None, last: int | None) -> None:
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.table, self.parts = options["path"], options["table"], max(1, int(options.get("parts", 8)))
        self.columns = [(f.name, isinstance(f.dataType, StringType), isinstance(f.dataType, DoubleType)) for f in schema]

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids; a view or a table without row ids is one partition."""
        db = connect(self.path)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:
            low = high = None
        finally:
            db.close()
        if not isinstance(low, int) or not isinstance(high, int):
            return [_Rows(None, None)]
        size = -(-(high - low + 1) // self.parts)
        return [_Rows(a, min(high, a + size - 1)) for a in range(low, high + 1, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f"CAST({_quoted(n)} AS TEXT)" if text else f"CAST({_quoted(n)} AS REAL)" if real else _quoted(n) for n, text, real in self.columns)
        where, args = ("", ()) if partition.first is None else (" WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
        db = connect(self.path)
        try:
            yield from db.execute(f"SELECT {names} FROM {_quoted(self.table)}{where}", args)
        finally:
            db.close()


class SqliteTable(DataSource):
    """spark.read.format("sqlite_table"): a table of a SQLite file in a folder that driver and
    executors share. Options: path, table, parts (8). Take a snapshot first where others write."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        db = connect(options["path"])
        try:
            found = db.execute(f"PRAGMA table_info({_quoted(options['table'])})").fetchall()
        finally:
            db.close()
        if not found:
            raise ValueError(f"no table {options['table']}")
        return StructType([StructField(c[1], _type(c[2])) for c in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
