"""Finding the keys that several documents share, without shuffling keys as rows.

The documents are written once to the shared folder in packs: runs of rows of about
PACK_BYTES of text, each with its number. A scan task reads packs as they stand, gathers
their 64-bit keys, merges repeats, and sends one compact row of arrays to each bucket of
the key space; a bucket keeps the keys that enough documents hold and answers each pack
with those of its own. A key that every document holds reaches its bucket once for each
pack (twice where a scan task ends inside a pack), so the rows of a bucket are bounded by
the number of packs, never by that of documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, settle, text_bytes

PACK_BYTES = 12 << 20
#: Bytes of text whose keys a bucket of the key space gets. Larger than a pack, so that the
#: rows that a scan task sends to each bucket stay well filled.
BUCKET_BYTES = 128 << 20
#: Bytes of text that are looked at side by side.
BLOCK_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
LOW48 = np.uint64((1 << 48) - 1)
#: Rows with a key from which it is told to be hot.
HOT = 2048


class Block:
    """Texts end to end, each with a newline after it, so that no word and no line runs
    from one into the next. ids: doc_id of each (NO_ID for null); starts: where it begins;
    rows: its number in the pack."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, rows: np.ndarray) -> None:
        self.texts, self.ids, self.rows = texts, ids, rows
        self.data = b"\n".join(texts) + b"\n"
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(size) - size


def blocks(t: pa.RecordBatch | pa.Table, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of one pack (columns doc_id, text, _row) in blocks of about `size` bytes."""
    ids = pc.fill_null(t.column("doc_id"), pa.scalar(NO_ID, pa.int64())).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else pc.fill_null(t.column("doc_id"), pa.scalar(NO_ID, pa.int64())).to_numpy()
    rows, text = np.asarray(t.column("_row")), t.column("text").to_pylist()
    lo = 0
    while lo < len(text):
        at, held = lo, 0
        while at < len(text) and held < size:
            held += len(text[at])
            at += 1
        yield Block(text[lo:at], ids[lo:at], rows[lo:at])
        lo = at


def in_order(t: pa.Table) -> pa.Table:
    """A pack's rows in the order in which they were written; a shuffle may change it."""
    return t.sort_by("_row")


def packed(docs: DataFrame) -> tuple[DataFrame, int]:
    """_pack, _row, doc_id and text (as bytes), written to the shared folder in packs, and
    a number of buckets for keys. A repeated row is a row like any other: it lies in the
    pack of its neighbours. doc_id must be of an integral type (others raise TypeError at
    once); a null one counts as larger than any other."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"doc_id must be an integer, not {kind}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, row = TaskContext.get().partitionId(), 0, 0
        for b in stream:
            size = np.asarray(pc.binary_length(b.column("text")), np.int64)
            upto = before + np.cumsum(size)
            pack = (np.int64(task) << 32) + (upto - size) // PACK_BYTES
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([pa.array(pack), pa.array(row + np.arange(len(size))), b.column("doc_id"), b.column("text"), pa.array(size)], names=["_pack", "_row", "doc_id", "text", "_size"])
            row += len(size)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    packs = settle(plain.mapInArrow(run, "_pack long, _row long, doc_id long, text binary, _size long"))
    size = packs.agg(F.sum("_size")).first()[0] or 0
    return packs.drop("_size"), max(parts(docs.sparkSession), math.ceil(size / BUCKET_BYTES))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(buckets)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many rows hold each, and the least id among them. row: the place
    in ids of the row that holds a key; a row counts once however often it holds it."""
    order = np.lexsort((row, keys))
    keys, row = keys[order], row[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])) if len(keys) else np.zeros(0, bool)
    keys, doc = keys[once], ids[row[once]]
    first = starts_of(keys)
    if not len(first):
        return keys, np.zeros(0, np.int64), doc
    return keys[first], np.diff(np.append(first, len(keys))), np.minimum.reduceat(doc, first)


def _rows(sets: dict[int, list], buckets: int, ids: bool) -> Iterator[pa.RecordBatch]:
    """From pack -> [(keys, counts, least ids)]: for each bucket one row of arrays: the
    packs, how many keys each has, the keys, how many rows hold them, the least id."""
    per_pack = []
    for pack, found in sorted(sets.items()):
        keys, count, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        keys, count, doc = keys[order], count[order], doc[order]
        first = starts_of(keys)
        per_pack.append((pack, keys[first], np.minimum(np.add.reduceat(count, first), 255).astype(np.uint8), np.minimum.reduceat(doc, first)))
    if not per_pack:
        return
    pack = np.repeat(np.array([p for p, *_ in per_pack], np.int64), [len(k) for _, k, _, _ in per_pack])
    keys, count, doc = (np.concatenate([x[i] for x in per_pack]) for i in (1, 2, 3))
    where = bucket_of(keys, buckets)
    order = np.argsort(where, kind="stable")
    pack, keys, count, doc, where = pack[order], keys[order], count[order], doc[order], where[order]
    cuts = np.append(starts_of(where), len(where))
    rows = {k: [] for k in ("bucket", "packs", "runs", "high", "low", "count", "ids")}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p = pack[a:b]
        start = starts_of(p)
        rows["bucket"].append(int(where[a]))
        rows["packs"].append(p[start].tobytes())
        rows["runs"].append(np.diff(np.append(start, len(p))).astype(np.uint32).tobytes())
        # the bucket and 48 bits tell keys apart well enough to filter by; with ids all 64 are kept
        rows["high"].append((keys[a:b] >> np.uint64(32)).astype(np.uint32 if ids else np.uint16).tobytes())
        rows["low"].append(keys[a:b].astype(np.uint32).tobytes())
        rows["count"].append(count[a:b].tobytes())
        rows["ids"].append(doc[a:b].tobytes() if ids else b"")
    yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[k], pa.binary()) for k in list(rows)[1:]]], names=list(rows))


def recurring(packs: DataFrame, buckets: int, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], least: int, ids: bool = False) -> DataFrame:
    """Rows _pack, keys, ids, hot: arrays (as bytes) of those keys of the pack's documents
    that at least `least` rows hold (2 to 255), with ids the least doc_id for each, and
    whether HOT rows or more hold it. keys_of gives the keys of a block and the place of
    the document that holds each. Without ids a key is known by 48 of its bits and its
    bucket (see as_filter), so a few more may pass: a filter, to be followed by an exact
    step."""
    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for b in stream:
            pack = np.asarray(b.column("_pack"))
            cuts = np.append(starts_of(pack), len(pack))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for block in blocks(b.slice(lo, hi - lo)):
                    found = counted(*keys_of(block), block.ids)
                    sets.setdefault(int(pack[lo]), []).append(found)
                    held += len(found[0])
            if held > 4_000_000:  # bounds the task's memory; the buckets merge what is sent twice
                yield from _rows(sets, buckets, ids)
                sets, held = {}, 0
        yield from _rows(sets, buckets, ids)

    def choose(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        high, low = read("high", np.uint32 if ids else np.uint16), read("low", np.uint32)
        key = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        pack, count = np.repeat(read("packs", np.int64), read("runs", np.uint32)), read("count", np.uint8)
        doc = read("ids", np.int64) if ids else np.zeros(len(key), np.int64)
        order = np.lexsort((pack, key))
        key, pack, count, doc = key[order], pack[order], count[order].astype(np.int64), doc[order]
        out = {"_pack": [], "keys": [], "ids": [], "hot": []}
        if len(key):
            first = starts_of(key)
            size = np.diff(np.append(first, len(key)))
            total = np.repeat(np.add.reduceat(count, first), size)
            doc = np.repeat(np.minimum.reduceat(doc, first), size)
            ok = (total >= least) & np.append(True, (key[1:] != key[:-1]) | (pack[1:] != pack[:-1]))
            key, pack, doc, hot = key[ok], pack[ok], doc[ok], (total >= HOT)[ok]
            if not ids:
                key = key | np.uint64(int(t.column("bucket")[0].as_py()) & 0xFFFF) << np.uint64(48)
            order = np.argsort(pack, kind="stable")
            key, pack, doc, hot = key[order], pack[order], doc[order], hot[order]
            cuts = np.append(starts_of(pack), len(pack))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out["_pack"].append(int(pack[a]))
                out["keys"].append(key[a:b].tobytes())
                out["ids"].append(doc[a:b].tobytes() if ids else b"")
                out["hot"].append(hot[a:b].tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "_pack" else pa.binary()) for k, v in out.items()})

    sent = packs.mapInArrow(gather, "bucket int, packs binary, runs binary, high binary, low binary, count binary, ids binary")
    return sent.groupBy("bucket").applyInArrow(choose, "_pack long, keys binary, ids binary, hot binary")


def as_filter(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The form in which recurring() without ids returns keys."""
    return keys & LOW48 | (bucket_of(keys, buckets) & np.uint64(0xFFFF)) << np.uint64(48)


def answers(t: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    """The arrays of a pack's rows end to end, sorted by the first."""
    out = [np.frombuffer(b"".join([x for x in t.column(c).to_pylist() if x]), kind) for c, kind in columns]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at
