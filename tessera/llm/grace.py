"""Exact deduplication by Grace hashing.

Every input partition first drops its own copies, so a text that fills a third of
the corpus reaches the shuffle as one row for each partition. The shuffle deals
texts out by content hash; each task hash-partitions its rows into spill files,
recursively, until a bucket fits an open-addressing table that compares complete
content."""

from __future__ import annotations

import hashlib
import os
import pickle
import random
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLANK_BYTES, numbered_columns, text_bytes

#: A record: digest of the content, content, code points, id, count, payload.
DIGEST, CONTENT, LENGTH, ID, COUNT, PAYLOAD = range(6)


def better(a: tuple, b: tuple) -> bool:
    """Whether record a stays before record b: more code points, then the smaller
    id; a null id comes last."""
    if a[LENGTH] != b[LENGTH]:
        return a[LENGTH] > b[LENGTH]
    if a[ID] is None or b[ID] is None:
        return a[ID] is not None and b[ID] is None
    return a[ID] < b[ID]


def weight(record: tuple) -> int:
    """Bytes that a record takes, about: content, payload and what Python adds."""
    total = len(record[CONTENT]) + 400
    row = record[PAYLOAD]
    for v in row.values() if isinstance(row, dict) else () if row is None else (row,):
        total += 60 + (len(v) * (1 if isinstance(v, bytes) or v.isascii() else 4) if isinstance(v, str | bytes) else 0 if v is None or isinstance(v, int | float | bool) else 4 * len(repr(v)))
    return total


class OpenTable:
    """Open addressing with linear probing. A slot holds the number of a group; two
    records meet only if their complete content is equal. bytes: of all that it holds."""

    def __init__(self) -> None:
        self.slots, self.groups, self.hashes, self.bytes = [-1] * 1024, [], [], 0

    def add(self, record: tuple) -> None:
        h = int.from_bytes(record[DIGEST][:8], "big")
        mask, slots = len(self.slots) - 1, self.slots
        i = h & mask
        while (g := slots[i]) >= 0:
            if self.hashes[g] == h and self.groups[g][CONTENT] == record[CONTENT]:
                held = self.groups[g]
                n = held[COUNT] + record[COUNT]
                kept = record if better(record, held) else held
                self.bytes += weight(kept) - weight(held) if kept is record else 0
                self.groups[g] = (*kept[:COUNT], n, kept[PAYLOAD])
                return
            i = (i + 1) & mask
        slots[i] = len(self.groups)
        self.groups.append(record)
        self.hashes.append(h)
        self.bytes += weight(record)
        if len(self.groups) * 10 > len(slots) * 6:
            self._grow()

    def _grow(self) -> None:
        mask = len(self.slots) * 2 - 1
        slots = [-1] * (mask + 1)
        for g, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = g
        self.slots = slots


def grace(records: Iterable[tuple], budget: int, fanout_bits: int = 4, level: int = 0) -> Iterator[tuple]:
    """One record for each distinct content. Holds at most about `budget` bytes of
    distinct content and payload: beyond it, what has been read and what follows goes to spill
    files by the next bits of the digest, and each file is handled alike. Content
    whose digests agree in all bits can't be split and stays in one table."""
    table, source = OpenTable(), iter(records)
    deepest = (level + 1) * fanout_bits > 128
    for record in source:
        table.add(record)
        if table.bytes > budget and not deepest:
            break
    else:
        yield from table.groups
        return
    shift, mask = 256 - (level + 1) * fanout_bits, (1 << fanout_bits) - 1
    # Spark's own local folders: they go with the executor, and its tasks run again elsewhere
    folders = [x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(x)]
    folder = random.choice(folders) if folders else None
    files = [tempfile.TemporaryFile(dir=folder) for _ in range(mask + 1)]
    try:
        def spill(record: tuple) -> None:
            pickle.dump(record, files[int.from_bytes(record[DIGEST], "big") >> shift & mask], 5)

        for record in table.groups:
            spill(record)
        del table
        for record in source:
            spill(record)
        for f in files:
            f.seek(0)
            yield from grace(_unpickled(f), budget, fanout_bits, level + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _unpickled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def distinct_texts(docs: DataFrame, payload: list[str] | None = None, text: str = "text", key: str = "doc_id", budget: int = 48 << 20) -> DataFrame:
    """One row for each distinct text: the payload columns of the row that stays
    (all columns of docs if None), `_sha256` of the normalised text in hex and
    `_copies`, the number of rows. Texts are equal when identical without the
    characters [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with
    the most code points, then the smallest key stays; null keys come last; of
    wholly equal rows one stays. An empty table gives an empty table."""
    payload = list(docs.columns) if payload is None else payload
    # a payload that has the text brings it along once: the content is made from it again
    inside = text in payload
    fields = [T.StructField("_sha", T.BinaryType()), T.StructField("_length", T.LongType()), T.StructField("_key", docs.schema[key].dataType), T.StructField("_copies", T.LongType()), T.StructField("_payload", T.StructType([docs.schema[c] for c in payload]))]
    rest = T.StructType(fields)
    struct = rest if inside else T.StructType([T.StructField("_content", T.BinaryType()), *fields])
    wide, narrow = to_arrow_schema(struct), to_arrow_schema(rest)

    def records(stream: Iterator[pa.RecordBatch], hashed: bool) -> Iterator[tuple]:
        for b in stream:
            columns = [b.column(c) for c in ("_length", "_key", "_copies", "_payload")]
            contents = None if inside else b.column("_content")
            shas = b.column("_sha") if hashed else None
            for i in range(b.num_rows):
                length, k, n, row = (c[i].as_py() for c in columns)
                if inside:
                    content = (row[text] or "").encode().translate(None, BLANK_BYTES)
                else:
                    content = contents[i].as_py()
                    content = content if hashed else content.translate(None, BLANK_BYTES)
                yield shas[i].as_py() if hashed else hashlib.sha256(content).digest(), content, length, k, n, row

    def out(groups: Iterator[tuple], schema: pa.Schema, content: bool) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for g in groups:
            held.append(g)
            size += weight(g)
            if size > 4 << 20:
                yield pack(held, schema, content)
                held, size = [], 0
        if held:
            yield pack(held, schema, content)

    def pack(held: list, schema: pa.Schema, content: bool) -> pa.RecordBatch:
        order = [CONTENT] * (content and not inside) + [DIGEST, LENGTH, ID, COUNT, PAYLOAD]
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in held], f.type) for i, f in zip(order, schema, strict=True)], schema=schema)

    local = docs.select(*[text_bytes(text).alias("_content")] * (not inside), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("_length"), F.col(key).alias("_key"), F.lit(1).cast("long").alias("_copies"), F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_payload"))
    local = local.mapInArrow(lambda s: out(grace(records(s, False), budget), wide, True), struct)
    merged = local.repartition("_sha").mapInArrow(lambda s: out(grace(records(s, True), budget), narrow, False), rest)
    return merged.select("_payload.*", F.lower(F.hex("_sha")).alias("_sha256"), "_copies", F.col("_key").alias("_keep"))


def normalised_shas(docs: DataFrame) -> DataFrame:
    """doc_id and text_sha256 of every row: the digest of the normalised text."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            shas = [hashlib.sha256(x.translate(None, BLANK_BYTES)).hexdigest() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.string())], names=["doc_id", "text_sha256"])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {key}, text_sha256 string")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Rules of
    distinct_texts. Rows that repeat the doc_id of the row that stays all carry
    kept = true; use keep_distinct to keep one physical row."""
    groups = distinct_texts(docs, ["doc_id"]).select(F.col("_sha256").alias("text_sha256"), F.col("_keep").alias("keep_id"), F.col("_copies").alias("group_size"))
    return normalised_shas(docs).join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs, whatever their names: one physical row
    for each distinct text by the rules of distinct_texts. Null and empty texts are one
    text; of rows that repeat an id and a text one stays; an empty table stays empty. Each
    distinct text is shuffled once for each partition that holds it."""
    plain, back = numbered_columns(docs)
    return distinct_texts(plain, None, *[f"c{docs.columns.index(c)}" for c in ("text", "doc_id")]).select(*back)


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
