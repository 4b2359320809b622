"""Byte-level BPE with a segment tree of pair ranks.

The leaves of the tree are the byte positions of one piece of text; a leaf holds
the rank of the pair of the live token at that position and its live neighbour,
with the position in the low bits, so the root is the leftmost minimum. A merge
updates three leaves (the merged token, its left neighbour, the token that went)
and the path above each. Short pieces are handled side by side as rows of one
array, long ones alone."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NONE = 1 << 60
#: Pieces up to so many bytes are encoded side by side.
SIDE_BY_SIDE = 64
#: Bytes of pieces and ids that a worker remembers, and of the longest such piece.
REMEMBERED, LONGEST = 64 << 20, 256


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.by_text = {str(i): b for i, b in self.bytes.items()}
        self.known: dict[str, str] = {}
        self.held = 0

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair of tokens a and b; NONE where it isn't in the vocabulary."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE >> 16)

    def _tree(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        """Pieces of 2 to `leaves` bytes each, as rows of one array of trees."""
        m, levels = len(pieces), leaves.bit_length() - 1
        length = np.array([len(p) for p in pieces])
        token = np.zeros((m, leaves), np.int64)
        flat = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(m, leaves)
        token[:] = self.of_byte[flat]
        place = np.arange(leaves)
        after = np.tile(place + 1, (m, 1))
        before = np.tile(place - 1, (m, 1))
        live = place[None, :] < length[:, None]
        tree = np.full((m, 2 * leaves), NONE, np.int64)
        rank = self.pair(token[:, :-1], token[:, 1:])
        tree[:, leaves:-1] = np.where((place[None, 1:] < length[:, None]) & (rank < NONE >> 16), rank << 16 | place[None, :-1], NONE)
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            node = at + leaves
            tree[rows, node] = value
            for _ in range(levels):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            p, merged = root & 0xFFFF, root >> 16
            q = after[rows, p]
            r = after[rows, q]
            token[rows, p] = merged
            live[rows, q] = False
            after[rows, p] = r
            inside = r < length[rows]
            before[rows[inside], r[inside]] = p[inside]
            put(rows, q, NONE)
            right = np.minimum(r, leaves - 1)
            rank = np.where(inside, self.pair(merged, token[rows, right]), NONE >> 16)
            put(rows, p, np.where(rank < NONE >> 16, rank << 16 | p, NONE))
            o = before[rows, p]
            left = o >= 0
            lr, lo = rows[left], o[left]
            rank = self.pair(token[lr, lo], merged[left])
            put(lr, lo, np.where(rank < NONE >> 16, rank << 16 | lo, NONE))
            rows = rows[tree[rows, 1] < NONE]
        ids, count = token[live].tolist(), live.sum(1).tolist()
        out, at = [], 0
        for n in count:
            out.append(ids[at : at + n])
            at += n
        return out

    def _long(self, piece: bytes) -> list[int]:
        """The same tree for one piece of any length."""
        n, leaves = len(piece), 1 << (len(piece) - 1).bit_length()
        token = self.of_byte[np.frombuffer(piece, np.uint8)]
        nodes = np.full(2 * leaves, NONE, np.int64)
        rank = self.pair(token[:-1], token[1:])
        nodes[leaves : leaves + n - 1] = np.where(rank < NONE >> 16, rank << 32 | np.arange(n - 1), NONE)
        lo = leaves
        while lo > 1:
            nodes[lo // 2 : lo] = np.minimum(nodes[lo : 2 * lo : 2], nodes[lo + 1 : 2 * lo : 2])
            lo //= 2
        # arrays of 8 bytes a node: fewer than 50 bytes for each byte of the piece in all
        tree, token, after, before = array("q", nodes.tobytes()), array("q", token.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        del nodes, rank
        pairs = self._pairs()

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        def leaf(a: int, b: int) -> int:
            rank = pairs.get(token[a] << 32 | token[b]) if b < n else None
            return NONE if rank is None else rank << 32 | a

        gone = bytearray(n)
        while (root := tree[1]) < NONE:
            p = root & 0xFFFFFFFF
            q = after[p]
            r = after[p] = after[q]
            token[p], gone[q] = root >> 32, 1
            if r < n:
                before[r] = p
            put(q, NONE)
            put(p, leaf(p, r))
            if (o := before[p]) >= 0:
                put(o, leaf(o, p))
        return [t for t, dead in zip(token, gone, strict=True) if not dead]

    def _pairs(self) -> dict[int, int]:
        if not hasattr(self, "_pair_dict"):
            self._pair_dict = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._pair_dict

    def pieces(self, pieces: Iterable[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        pieces = list(pieces)
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            if n < 2:
                out[i] = [int(self.of_byte[p[0]])] if n else []
            elif n > SIDE_BY_SIDE:
                out[i] = self._long(p)
            else:
                groups.setdefault(1 << (n - 1).bit_length(), []).append(i)
        for leaves, members in groups.items():
            for lo in range(0, len(members), 8192):
                part = members[lo : lo + 8192]
                for i, ids in zip(part, self._tree([pieces[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by one space."""
        found = [self.split(t) for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = list(set().union(*found).difference(self.known)) if found else []
        for piece, ids in zip(new, self.pieces(p.encode() for p in new), strict=True):
            self.known[piece] = coded = " ".join(map(str, ids))
            self.held += len(piece) + len(coded) + 150
        get = self.known.__getitem__
        out = [" ".join(map(get, f)) for f in found]
        for piece in new:
            if len(piece) > LONGEST:
                self.held -= len(piece) + len(self.known.pop(piece)) + 150
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_texts([text])[0].split()]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes[int(i)] for i in ids)

    def decode_ids(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(" "))) if ids else b""


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def tokenize(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again: doc_id, n_tokens,
    ids_sha256, decoded_sha256 and, with keep_ids, the ids as array<int>. Null and
    empty texts have no tokens. Very long texts are encoded whole, each match of the
    pattern by itself; a match takes some 50 bytes of memory for each of its own. Repeated
    rows come out alike, rows without doc_id with a null one; an empty table gives no rows.
    The vocabulary file at `path` must be readable on every executor."""
    own = default_vocabulary()
    path, pattern = path or own[0], pattern or own[1]
    key = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in stream:
            ids, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                some, size, at = [], 0, lo
                while at < batch.num_rows and size < 1 << 20:
                    some.append(texts[at].as_py())
                    size += len(some[-1])
                    at += 1
                coded = c.encode_texts(some)
                rows = [pa.array([x.count(" ") + 1 if x else 0 for x in coded], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coded]), pa.array([hashlib.sha256(c.decode_ids(x)).hexdigest() for x in coded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    rows.append(pa.array([[int(i) for i in x.split()] for x in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([ids.slice(lo, at - lo), *rows], names=names)
                lo = at

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, fields)
