"""Alignment of two tokenizers' tokens by distinct segments.

Texts are cut before runs of white space, where neither vocabulary can join what stands on
both sides: the byte-level tokenizer splits there before it merges, and no piece of the
other holds white space behind another sign (this is read from its vocabulary). So the
tokens of a text are those of its segments, one after the other. Scan tasks deal documents
into packs and send the distinct segments of each to buckets by hash; there every distinct
segment of the corpus is tokenised and aligned once. Its token pairs are counted as often as
it occurs, and the alignments go back to the packs that asked, where documents are composed
of them. A segment that every document holds reaches its bucket once for each pack."""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, settle

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Text of one pack, text whose segments a bucket gets (the distinct ones of each pack), and
#: text of the segments that are aligned side by side.
PACK_BYTES, BUCKET_BYTES, SLICE_BYTES = 10 << 20, 8 << 20, 64 << 10


class Tokenizers:
    """The byte-level tokenizer a and the piece tokenizer b, the bytes of each token, and
    where texts may be cut. Raises ValueError for files of which it can't be shown that
    segments stand for themselves."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("the first tokenizer must split bytes by the byte-level pattern, without a normalizer")
        vocab = self.a.get_vocab(with_added_tokens=False)
        if sum(len(x) == 1 for x in vocab) < 256:
            raise ValueError("the first vocabulary lacks single bytes")
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.a_size[i] = len(token)  # one sign stands for one byte

        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(b_file, "rb") as f:
            proto.ParseFromString(f.read())
        rule = proto.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the second tokenizer must leave texts as they are but for a space before them")
        n = self.b.get_piece_size()
        if sum(self.b.is_byte(i) for i in range(n)) < 256:
            raise ValueError("the second vocabulary lacks single bytes")
        pieces = [p.piece for p in proto.pieces]
        self.b_size = np.array([1 if self.b.is_byte(i) else len(pieces[i].replace(MARK, " ").encode()) for i in range(n)], np.int64)
        self.space = [self.b.piece_to_id(MARK)]
        if self.b.is_unknown(self.space[0]):
            raise ValueError("the second vocabulary lacks the single space")
        cuts = "".join(c for c in " \t\n\r\x0b\x0c" if not any(re.search(f"[^{x}]{x}", p) for x in [MARK if c == " " else c] for p in pieces))
        self.cut = re.compile(rf"(?<=\S)(?=[{cuts}])" if cuts else r"(?!)")

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text."""
        return self.cut.split(" " + text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by both. b puts a space before what it reads: it stands for the first sign
        of a segment that begins with one; before others it is a token of its own (no
        piece joins it to them), which is left out. Before nothing b puts no space."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return a, [self.space if s == " " else x if s[0] == " " else x[1:] for s, x in zip(segments, b, strict=True)]


@functools.cache
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: all lowest bytes, then all next ones, and so on, as
    small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


_PACKED = pa.schema([("_pack", pa.int64()), ("_bucket", pa.int32()), ("doc_id", pa.int64()), ("_order", pa.binary()), ("_segs", pa.string()), ("_times", pa.binary())])


def _rows(columns: dict[str, list], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _pack_rows(pack: int, ids: list, orders: list[np.ndarray], numbers: _Numbers, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of one pack. Its segments are numbered anew, the frequent ones first. Documents
    have the numbers of their segments in order; one row has the bucket of each number
    (without doc_id and _bucket); each bucket has one with its segments by number, and the
    times of each."""
    times = np.bincount(np.concatenate(orders), minlength=len(numbers))
    by_times = np.argsort(-times, kind="stable")
    new = np.empty(len(numbers), np.int64)
    new[by_times] = np.arange(len(numbers))
    names = list(numbers)
    names, times = [names[i] for i in by_times.tolist()], times[by_times]
    for lo in range(0, len(ids), 1000):
        some = orders[lo : lo + 1000]
        yield _rows({"_pack": [pack] * len(some), "_bucket": [-1] * len(some), "doc_id": ids[lo : lo + 1000], "_order": [_planes(new[x]) for x in some]}, len(some), _PACKED)
    of = np.fromiter((zlib.crc32(s.encode()) % buckets for s in names), np.int64, len(names))
    yield _rows({"_pack": [pack], "_order": [_planes(of)]}, 1, _PACKED)
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order], prepend=-1))
    for at in np.split(order, edges[1:]) if len(order) else []:
        yield _rows({"_pack": [pack], "_bucket": [int(of[at[0]])], "_segs": [MARK.join([names[i] for i in at.tolist()])], "_times": [_planes(times[at])]}, 1, _PACKED)


def packed(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Documents and distinct segments by pack, written to the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(docs.sparkSession), math.ceil(size / BUCKET_BYTES))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(a_file, b_file)
        pack, held, ids, orders, numbers = TaskContext.get().partitionId() << 32, 0, [], [], _Numbers()
        for batch in stream:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = text and MARK not in text  # b would give a mark back as a space
                found = tools.segments(text) if whole else []
                ids.append(doc_id)
                orders.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                held += len(text or "") + 1
                if held >= PACK_BYTES:
                    yield from _pack_rows(pack, ids, orders, numbers, buckets)
                    pack, held, ids, orders, numbers = pack + 1, 0, [], [], _Numbers()
        if ids:
            yield from _pack_rows(pack, ids, orders, numbers, buckets)

    kinds = "_pack long, _bucket int, doc_id long, _order binary, _segs string, _times binary"
    return settle(docs.mapInArrow(run, kinds), "zstd")


def _aligned(tools: Tokenizers, segments: list[str]) -> dict[str, list | np.ndarray]:
    """Of each segment: tokens, groups and links, the groups as text, and the links."""
    a_ids, b_ids = tools.encode(segments)
    a_n, b_n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
    a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, a_n), (b_ids, b_n)))
    a_end, b_end = np.cumsum(tools.a_size[a]), np.cumsum(tools.b_size[b])
    end = np.cumsum([len(s.encode()) for s in segments])
    a_last, b_last = np.cumsum(a_n), np.cumsum(b_n)
    if not (np.array_equal(a_end[a_last - 1], end) and np.array_equal(b_end[b_last - 1], end)):
        raise ValueError("tokens don't give their segment back")
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    a_cut, b_cut = np.searchsorted(a_end, both) + 1, np.searchsorted(b_end, both) + 1
    a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, k = [], 0, 0
    for j, m in zip(a_cut.tolist(), b_cut.tolist(), strict=True):
        groups.append(f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}")
        i, k = j, m
    upto = np.searchsorted(both, end) + 1
    a_start = a_end - tools.a_size[a]
    first, last = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_end, a_end)
    width = last - first + 1
    shift = np.cumsum(width) - width
    links = np.cumsum(width)[a_last - 1]
    return {
        "n_a": a_n, "n_b": b_n, "n_groups": np.diff(upto, prepend=0), "n_links": np.diff(links, prepend=0),
        "groups": [";".join(groups[x:y]) for x, y in itertools.pairwise([0, *upto.tolist()])],
        "pairs": np.repeat(a, width) << 32 | b[np.arange(int(width.sum())) + np.repeat(first - shift, width)],
    }


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_FOUND = pa.schema([("_bucket", pa.int32()), ("_pack", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64()), ("_which", pa.binary()), ("groups", pa.string()), *[(c, pa.binary()) for c in COUNTS], ("_links", pa.binary())])


def aligned(packs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Of each bucket, written to the shared folder: a row for each token pair with the times
    its links occur, one with the alignments of its distinct segments, and for each pack that
    asked one with the numbers of the segments asked for."""

    def run(asked: pa.Table) -> pa.Table:
        tools, numbers = tokenizers(a_file, b_file), _Numbers()
        bucket = asked.column("_bucket")[0].as_py()
        which = [np.fromiter(map(numbers.__getitem__, s.split(MARK)), np.int64) for s in asked.column("_segs").to_pylist()]
        times = np.zeros(len(numbers), np.int64)
        for x, t in zip(which, asked.column("_times").to_pylist(), strict=True):
            times[x] += _whole(t)  # a pack asks for a segment once
        names, found, lo = list(numbers), [], 0
        while lo < len(names):
            hi, held = lo, 0
            while hi < len(names) and held < SLICE_BYTES:
                held, hi = held + len(names[hi]), hi + 1
            found.append(_aligned(tools, names[lo:hi]))
            lo = hi
        count = {c: np.concatenate([x[c] for x in found]) for c in COUNTS}
        pairs, links = np.unique(np.concatenate([x["pairs"] for x in found]), return_inverse=True)
        seen = np.zeros(len(pairs), np.int64)
        np.add.at(seen, links, np.repeat(times, count["n_links"]))
        rows = [
            _rows({"_bucket": [bucket] * len(pairs), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "times": seen}, len(pairs), _FOUND),
            _rows({"_bucket": [bucket], "groups": ["\n".join(itertools.chain.from_iterable(x["groups"] for x in found))], "_links": [_planes(links)]} | {c: [_planes(v)] for c, v in count.items()}, 1, _FOUND),
            _rows({"_bucket": [bucket] * len(which), "_pack": asked.column("_pack").to_pylist(), "_which": [_planes(x) for x in which]}, len(which), _FOUND),
        ]
        return pa.Table.from_batches(rows)

    kinds = ", ".join(["_bucket int, _pack long, a int, b int, times long, _which binary, groups string", *[f"{c} binary" for c in COUNTS], "_links binary"])
    return settle(packs.where("_bucket >= 0").select("_bucket", "_pack", "_segs", "_times").groupBy("_bucket").applyInArrow(run, kinds), "zstd")


def pair_counts(found: DataFrame) -> DataFrame:
    """_of (the bucket), a, b, count, best: how many links of the corpus hold a bucket's pair
    of ids, and whether no pair with the same b has more. A pair stands once in a bucket; the
    largest counts by b are at most as many as the second vocabulary has ids."""
    pairs = found.where(F.col("times").isNotNull()).select(F.col("_bucket").alias("_of"), "a", "b", F.sum("times").over(Window.partitionBy("a", "b")).alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("_most"))
    return pairs.join(F.broadcast(most), "b").select("_of", "a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


SIZES = (*COUNTS, "n_best", "count_sum")


def _replies(found: pa.Table, pairs: pa.Table) -> pa.Table:
    """What each pack asked a bucket for: the alignments and scores of segments."""
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
    rows = found.to_pylist()
    whole = next(r for r in rows if r["_which"] is None)
    groups, links = whole["groups"].split("\n"), _whole(whole["_links"])
    size = {c: _whole(whole[c]) for c in COUNTS}
    first = np.cumsum(size["n_links"]) - size["n_links"]
    size["n_best"] = np.add.reduceat(pairs.column("best").to_numpy().astype(np.int64)[links], first)
    size["count_sum"] = np.add.reduceat(pairs.column("count").to_numpy()[links], first)
    asked = [(r["_pack"], _whole(r["_which"])) for r in rows if r["_which"] is not None]
    columns = {"_to": pa.array([p for p, _ in asked], pa.int64()), "_bucket": pa.array([whole["_bucket"]] * len(asked), pa.int32())}
    columns |= {c: pa.array([_planes(size[c][x]) for _, x in asked], pa.binary()) for c in SIZES}
    return pa.table(columns | {"groups": pa.array(["\n".join(map(groups.__getitem__, x.tolist())) for _, x in asked], pa.string())})


def _composed(docs: pa.Table, replies: pa.Table) -> pa.Table:
    head = docs.filter(pc.is_null(docs.column("_bucket")))
    docs = docs.filter(pc.is_valid(docs.column("_bucket")))
    of = _whole(head.column("_order")[0].as_py())
    size, groups = {c: np.zeros(len(of), np.int64) for c in SIZES}, np.empty(len(of), object)
    order = np.argsort(of, kind="stable")
    ranked = of[order]
    for r in replies.to_batches(max_chunksize=8):
        for row in r.to_pylist():
            at = order[np.searchsorted(ranked, row["_bucket"]) : np.searchsorted(ranked, row["_bucket"], side="right")]
            for c in SIZES:
                size[c][at] = _whole(row[c])
            groups[at] = row["groups"].split("\n")
    out: dict[str, list] = {c: [] for c in (*SIZES, "groups")}
    for raw in docs.column("_order").to_pylist():
        x = _whole(raw)
        for c in SIZES:
            out[c].append(int(size[c][x].sum()))
        out["groups"].append(";".join(groups[x].tolist()))
    kinds = {c: pa.int64() for c in SIZES} | {"groups": pa.string()}
    return pa.table({"doc_id": docs.column("doc_id")} | {c: pa.array(v, kinds[c]) for c, v in out.items()})


def alignments(docs: DataFrame, a_file: str = BYTE_LEVEL, b_file: str = PIECES) -> DataFrame:
    """One row per row of docs: doc_id, n_a and n_b (tokens of a space and the text by the
    two tokenizers), n_groups, n_links, n_best, count_sum and groups: `a1,a2|b1;a3|b2,b3`,
    ids between the byte offsets at which tokens of both end. A link is a pair of token
    occurrences whose bytes overlap; counts of id pairs are taken over all documents.

    Null and empty texts, and texts with U+2581 (which pieces give back as a space), have no
    tokens: zeros and ''. A null doc_id is kept; rows that repeat come out, and count, each;
    very long texts, and ones without white space, are read whole; an empty table gives no
    rows; further columns, whatever their names, are left out. doc_id is an integer."""
    tokenizers(a_file, b_file)  # files that don't qualify are refused before anything runs
    packs = packed(docs, a_file, b_file)
    found = aligned(packs, a_file, b_file)
    answers = found.where(F.col("times").isNull()).drop("a", "b", "times").groupBy("_bucket").cogroup(pair_counts(found).groupBy("_of"))
    replies = answers.applyInArrow(_replies, ", ".join(["_to long, _bucket int", *[f"{c} binary" for c in SIZES], "groups string"]))
    held = packs.where("_bucket IS NULL OR _bucket < 0").select("_pack", "_bucket", "doc_id", "_order")
    kinds = ", ".join(["doc_id long", *[f"{c} long" for c in SIZES], "groups string"])
    return held.groupBy("_pack").cogroup(replies.groupBy("_to")).applyInArrow(_composed, kinds)
