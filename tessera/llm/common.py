"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_folder, kept_in_scope, settle

#: What counts as white space in every word rule of this subpackage.
BLANKS = r"[\x20\x09-\x0D]"
#: The same characters as bytes, for bytes.translate and bytes.split().
BLANK_BYTES = b" \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session. Only where it is unset (tests on one machine) a temporary folder
    becomes the checkpoint folder."""
    return checkpoint_folder(spark)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str = "text") -> "F.Column":
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def u64(x: int) -> int:
    """Signed form of an unsigned 64-bit integer."""
    return x - (1 << 64) if x >> 63 else x


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+ of buf."""
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    if not blank[-1]:
        edge = np.concatenate([edge, [len(a)]])
    return edge[0::2], edge[1::2]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for i, base in enumerate((_ODD, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of mixed bytes, from prefix sums,
    with the word's length mixed in."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(buf, np.uint8)] * p[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words ^ np.uint64(salt)) * p[:-1], out=total[1:])
    return mix64((total[k:] - total[:-k]) * inv[:n])


def numbered_columns(docs: DataFrame, *needed: str) -> tuple[DataFrame, list["F.Column"]]:
    """docs with its columns renamed c0, c1, ... and the needed ones once more under their
    own names, so that no other column can clash with those that an operator adds; and the
    expressions that give the columns of docs back."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for name in needed:
        plain = plain.withColumn(name, F.col(f"c{docs.columns.index(name)}"))
    return plain, [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
