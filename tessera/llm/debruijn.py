"""Substring deduplication on a compacted De Bruijn graph of words.

The edges are the windows of K words; their nodes are the K - 1 words that neighbours
share. Edges that share their minimizer (of the ANCHOR-word pieces in a window, the one of
least hash) and follow each other in a document are compacted into one path. Because the
minimizer depends on the words alone, the inside of a repeated passage is cut into the
same paths wherever it stands.

1. Anchors that only one document holds are filtered out (recurring.py): their windows
   can't repeat.
2. The paths at the other anchors travel to their anchor with their words and the doc_id
   that holds them. Paths are equal if their words are, no hash decides; so spans are
   verified by the words that travel with them, not by a second look at the place where
   they stand (coordinates aren't sent). Where all paths at an anchor are one, every node inside has one edge in
   and one out: the path is nonbranching and stands or falls as a whole. Where they are
   several, nodes branch, and the edges are told apart one by one, by their words.
3. The verdicts go back to the packs of documents: a path is cut out of every document
   but its first; in the first, the edges that a smaller doc_id holds in another path.

An anchor that HOT documents or more hold (a frequent turn of words, whose windows may all
differ) isn't gathered: there each edge travels alone, to a bucket of its own hash. So a
bucket never holds more than one row of an edge for each pack, and paths of an anchor only
where few documents have it. The texts are shuffled once, as all cogroups share one
exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, settle, window_hashes, word_bounds, word_hashes
from .recurring import Block, answers, as_filter, blocks, bucket_of, found_in, in_order, packed, recurring, starts_of

K, ANCHOR = 13, 5
_EDGE = np.uint64(0x45444745)


class Paths:
    """The paths of a block's texts, in their order: anchor (hash), first (word), size (in
    edges), doc (place of the document in the block). words: all words of the block, one
    space between two; starts and ends of each; word_doc: the document of each."""

    def __init__(self, block: Block) -> None:
        starts, ends = word_bounds(block.data)
        self.hashes = word_hashes(block.data, starts, ends)
        self.size_of_words = ends - starts
        self.block, self.n = block, len(starts)
        self.first_word = np.append(np.searchsorted(starts, block.starts), len(starts))
        self.anchor, self.first, self.size, self.doc = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        if self.n < K:
            return
        owner = np.repeat(np.arange(len(block.texts)), np.diff(self.first_word))
        h = window_hashes(self.hashes, ANCHOR, 0x5EED)
        at = np.lib.stride_tricks.sliding_window_view(h, K - ANCHOR + 1).argmin(axis=1)
        at += np.arange(len(at))
        inside = np.flatnonzero(owner[: len(at)] == owner[K - 1 :])
        if not len(inside):
            return
        at, who = at[inside], owner[inside]
        new = np.append(True, (at[1:] != at[:-1]) | (who[1:] != who[:-1]))
        cuts = np.flatnonzero(new)
        self.first, self.size, self.doc = inside[cuts], np.diff(np.append(cuts, len(at))), who[cuts]
        self.anchor = h[at[cuts]]

    def spelled(self) -> None:
        """Makes words, starts and ends; only where words are read."""
        self.words = b" ".join(self.block.data.split())
        self.ends = np.cumsum(self.size_of_words + 1) - 1
        self.starts = self.ends - self.size_of_words

    def units(self, keys: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """What travels: the key of each unit, the document, the first word and the number of
        edges. A unit is a path at a wanted anchor, or one edge of a path at a hot one."""
        there, at = found_in(keys, as_filter(self.anchor, buckets))
        pick = np.flatnonzero(there)
        alone = hot[at[pick]] if len(pick) else np.zeros(0, bool)
        first, size, doc, key = self.first[pick], self.size[pick], self.doc[pick], self.anchor[pick]
        if alone.any():
            n = np.where(alone, size, 1)
            of = np.repeat(np.arange(len(pick)), n)
            first = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            edge = mix64(window_hashes(self.hashes, K)[first] ^ _EDGE)
            key = np.where(alone[of], edge, key[of])
            size, doc = np.where(alone[of], 1, size[of]), doc[of]
        return key, doc, first, size


def anchor_keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    p = Paths(block)
    return p.anchor, p.doc


def _distinct(docs: pa.Table, keys: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[dict[bytes, int], list[list]]:
    """The distinct units of a pack: the place of each by its words, and for each: key,
    least doc_id, whether several documents hold it."""
    place, found = {}, []
    for block in blocks(docs):
        p = Paths(block)
        key, doc, first, size = p.units(keys, hot, buckets)
        if not len(key):
            continue
        p.spelled()
        lo, hi = p.starts[first].tolist(), p.ends[first + size + K - 2].tolist()
        for k, d, a, b in zip(key.tolist(), block.ids[doc].tolist(), lo, hi, strict=True):
            words = p.words[a:b]
            at = place.get(words)
            if at is None:
                place[words] = len(found)
                found.append([k, d, False])
            else:
                held = found[at]
                if d != held[1]:
                    held[2] = True
                    held[1] = min(held[1], d)
    return place, found


def _edges(words: bytes) -> list[bytes]:
    """The windows of a path, as words."""
    w = words.split(b" ")
    return [b" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]


def _judged(units: list[tuple[int, int, bool, bytes]]) -> list[tuple[int, int, int]]:
    """units: key, least doc_id, whether several documents, words. For each: the first
    holder, 1 if another document has it too, and a mask of the edges that a smaller
    doc_id holds in another path at its anchor."""
    at_key: dict[int, dict[bytes, list[int]]] = {}
    for i, (key, _, _, words) in enumerate(units):
        at_key.setdefault(key, {}).setdefault(words, []).append(i)
    out: list = [None] * len(units)
    for paths in at_key.values():
        first = {}
        for words, members in paths.items():
            ids = {units[i][1] for i in members}
            first[words] = (min(ids), len(ids) > 1 or any(units[i][2] for i in members))
        masks = dict.fromkeys(paths, 0)
        if len(paths) > 1:
            edges = {words: _edges(words) for words in paths}
            least: dict[bytes, int] = {}
            for words, found in edges.items():
                d = first[words][0]
                for e in found:
                    if least.get(e, d) >= d:
                        least[e] = d
            for words, found in edges.items():
                d = first[words][0]
                masks[words] = sum(1 << j for j, e in enumerate(found) if least[e] < d)
        for words, members in paths.items():
            d, several = first[words]
            for i in members:
                out[i] = (d, int(several), masks[words])
    return out


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256. A word goes if a
    window of 13 words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Null and empty texts have no words (the hash is
    that of the empty string). doc_id is an integer (other types raise TypeError), a null
    one counts as larger than any other, and rows that share a doc_id don't remove each
    other's words. Very long texts are read whole. An empty table gives no rows. Windows
    are told apart by their words."""
    packs, buckets = packed(docs)
    wanted = settle(recurring(packs, buckets, anchor_keys, 2).drop("ids"))
    by_pack = lambda df: df.groupBy("_pack")

    def send(docs_: pa.Table, filters: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "pack", "index", "key", "doc", "several", "size", "words")}
        keys, hot = answers(filters, ("keys", np.uint64), ("hot", np.bool_))
        if len(keys) and docs_.num_rows:
            docs_ = in_order(docs_)
            place, found = _distinct(docs_, keys, hot, buckets)
            if found:
                words = list(place)
                key = np.array([f[0] for f in found], np.uint64)
                doc = np.array([f[1] for f in found], np.int64)
                several = np.array([f[2] for f in found], np.bool_)
                size = np.fromiter(map(len, words), np.uint32, len(words))
                where = bucket_of(mix64(key), buckets)
                order = np.argsort(where, kind="stable")
                cuts = np.append(starts_of(where[order]), len(order))
                pack = docs_.column("_pack")[0].as_py()
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    at = order[x:y]
                    out["bucket"].append(int(where[at[0]]))
                    out["pack"].append(pack)
                    for name, values in (("index", at.astype(np.uint32)), ("key", key[at]), ("doc", doc[at]), ("several", several[at]), ("size", size[at])):
                        out[name].append(values.tobytes())
                    out["words"].append(b"".join([words[i] for i in at.tolist()]))
        kinds = {"bucket": pa.int32(), "pack": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def judge(t: pa.Table) -> pa.Table:
        units, owner = [], []
        for r in range(t.num_rows):
            read = lambda c, kind: np.frombuffer(t.column(c)[r].as_buffer(), kind)  # noqa: B023, E731
            size, words = read("size", np.uint32), t.column("words")[r].as_py()
            end = np.cumsum(size, dtype=np.int64)
            units += [(k, d, s, words[a:b]) for k, d, s, a, b in zip(read("key", np.uint64).tolist(), read("doc", np.int64).tolist(), read("several", np.bool_).tolist(), (end - size).tolist(), end.tolist(), strict=True)]
            owner.append(len(size))
        out, at, verdicts = {"_pack": [], "index": [], "doc": [], "mask": []}, 0, _judged(units)
        for r, n in enumerate(owner):
            part = np.array(verdicts[at : at + n], np.int64).reshape(n, 3)
            at += n
            tell = (part[:, 1] > 0) | (part[:, 2] > 0)
            if tell.any():
                out["_pack"].append(t.column("pack")[r].as_py())
                out["index"].append(np.frombuffer(t.column("index")[r].as_buffer(), np.uint32)[tell].tobytes())
                out["doc"].append(part[tell, 0].tobytes())
                out["mask"].append(part[tell, 2].astype(np.uint16).tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "_pack" else pa.binary()) for k, v in out.items()})

    def cut(docs_: pa.Table, told: pa.Table) -> pa.Table:
        keys, hot = answers(told, ("keys", np.uint64), ("hot", np.bool_))
        index, least, mask = answers(told, ("index", np.uint32), ("doc", np.int64), ("mask", np.uint16))
        out = {"n_words": [], "n_removed": [], "kept_sha256": []}
        docs_ = in_order(docs_)
        place: dict[bytes, int] = {}
        for block in blocks(docs_):
            for words, kept in _kept(block, keys, hot, buckets, place, index, least, mask):
                out["n_words"].append(words)
                out["n_removed"].append(words - kept[1])
                out["kept_sha256"].append(hashlib.sha256(kept[0]).hexdigest())
        kinds = {"kept_sha256": pa.string()}
        return pa.table({"doc_id": docs_.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    units = by_pack(packs).cogroup(by_pack(wanted)).applyInArrow(send, "bucket int, pack long, index binary, key binary, doc binary, several binary, size binary, words binary")
    verdicts = units.groupBy("bucket").applyInArrow(judge, "_pack long, index binary, doc binary, mask binary")
    none = F.lit(None).cast("binary")
    told = wanted.select("_pack", "keys", "hot", none.alias("index"), none.alias("doc"), none.alias("mask")).union(verdicts.select("_pack", none, none, "index", "doc", "mask"))
    return by_pack(packs).cogroup(by_pack(told)).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(block: Block, keys: np.ndarray, hot: np.ndarray, buckets: int, place: dict[bytes, int], index: np.ndarray, least: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, tuple[bytes, int]]]:
    """For each document of a block its number of words, and the words that stay, joined by
    one space, with their number. place numbers the pack's units as send did, across blocks."""
    if not len(keys):
        for text in block.texts:
            w = text.split()
            yield len(w), (b" ".join(w), len(w))
        return
    p = Paths(block)
    key, doc, first, size = p.units(keys, hot, buckets)
    p.spelled()
    bounds = p.first_word.tolist()
    bad = np.zeros(p.n + 1, bool)
    if len(key):
        lo, hi = p.starts[first].tolist(), p.ends[first + size + K - 2].tolist()
        number = np.fromiter((place.setdefault(p.words[a:b], len(place)) for a, b in zip(lo, hi, strict=True)), np.int64, len(lo))
        there, at = found_in(index, number.astype(np.uint32))
        pick = np.flatnonzero(there)
        at, ids = at[pick], block.ids[doc[pick]]
        whole = pick[ids > least[at]]
        gone = np.zeros(p.n + 2, np.int64)
        np.add.at(gone, first[whole], 1)
        np.add.at(gone, first[whole] + size[whole], -1)
        bad = np.cumsum(gone)[: p.n + 1] > 0
        part = (ids == least[at]) & (mask[at] > 0)
        for i, m in zip(first[pick[part]].tolist(), mask[at[part]].tolist(), strict=True):
            for j in range(m.bit_length()):
                if m >> j & 1:
                    bad[i + j] = True
    where = np.flatnonzero(bad)
    cover = np.zeros(p.n + K + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + K, -1)
    keep = np.cumsum(cover)[: p.n] == 0
    removed = np.append(0, np.cumsum(~keep))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            yield 0, (b"", 0)
        elif removed[a] == removed[b]:
            yield b - a, (p.words[p.starts[a] : p.ends[b - 1]], b - a)
        else:
            stay = a + np.flatnonzero(keep[a:b])
            new = np.append(True, np.diff(stay) > 1) if len(stay) else np.zeros(0, bool)
            run = np.flatnonzero(new)
            last = np.append(run[1:], len(stay)) - 1 if len(run) else run
            pieces = [p.words[x:y] for x, y in zip(p.starts[stay[run]].tolist(), p.ends[stay[last]].tolist(), strict=True)]
            yield b - a, (b" ".join(pieces), len(stay))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM e),
r AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM f WHERE m < doc_id)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
