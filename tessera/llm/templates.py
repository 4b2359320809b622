"""Line deduplication by a tree of log templates.

A line goes down a tree of fixed depth: the number of its tokens, then its leading
tokens, with variable ones (digits, addresses, long mixes) as a wildcard. At the leaf its
other tokens, variable ones generalised likewise, are its template. A line of LONG tokens
or more is also tested for similarity at the leaf: the tokens after the leading ones are
cut into BLOCKS runs, and two lines that agree in all but one run are of one template,
with that run as a variable field; so a line goes only for a line of the same length that
equals it in at least 3 of 4 runs and in the leading tokens. Unlike a parser that reads a
stream, the templates of a line depend on the line alone, so the same tree grows on any
number of machines, in any order. A line whose template recurs in enough documents is
dropped everywhere but in the document with the smallest id."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, powers, word_bounds, word_hashes
from .recurring import Block, answers, blocks, found_in, in_order, packed, recurring

DEPTH, MIN_DOCS, LONG, WIDE, BLOCKS = 3, 3, 12, 40, 4
_SIGNS = np.zeros(256, np.int32)
for _c in b"0123456789@\\":
    _SIGNS[_c] = 1
_WILD_HASH = mix64(np.array([0x57494C44], np.uint64))[0]
#: Told apart in the key: the whole template, and those with one run free.
_WHOLE, *_FREE = mix64(np.arange(101, 102 + BLOCKS, dtype=np.uint64))


def line_keys(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the templates of all lines of a text, the line that each belongs to, and
    the number of lines. Hashes of runs of tokens come from one prefix sum."""
    raw = np.frombuffer(text, np.uint8)
    ends_of_lines = np.flatnonzero(raw == 10)
    n_lines = len(ends_of_lines) + 1
    starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_lines
    token = word_hashes(text, starts, ends)
    sign = _SIGNS[raw]
    if b"://" in text:
        sign[[m.start() for m in re.finditer(b"://", text)]] = 1
    seen = np.append(np.int32(0), np.cumsum(sign, dtype=np.int32))
    token[(seen[ends] > seen[starts]) | (ends - starts >= WIDE)] = _WILD_HASH
    cuts = np.append(0, np.append(np.searchsorted(starts, ends_of_lines), len(starts)))
    a, b = cuts[:-1], cuts[1:]
    line = np.flatnonzero(b > a)
    a, b = a[line], b[line]
    p, inv = powers(len(token) + 1)
    total = np.append(np.uint64(0), np.cumsum(token * p[:-1]))
    run = lambda x, y: (total[y] - total[x]) * inv[x]
    count = mix64((b - a).astype(np.uint64))
    keys, of = [mix64(run(a, b) + count + _WHOLE)], [line]
    long = b - a >= LONG
    if long.any():
        la, lb, node = a[long], b[long], mix64(run(a[long], a[long] + DEPTH) + count[long])
        rest = lb - la - DEPTH
        edge = [la + DEPTH + rest * i // BLOCKS for i in range(BLOCKS + 1)]
        for i, kind in enumerate(_FREE):
            keys.append(mix64(mix64(node + run(edge[0], edge[i])) ^ (run(edge[i + 1], edge[BLOCKS]) + kind)))
            of.append(line[long])
    return np.concatenate(keys), np.concatenate(of), n_lines


def block_keys(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a block's lines, the line of each, and the first line of each document (and
    of what would follow)."""
    keys, line, n = line_keys(block.data)
    ends = np.flatnonzero(np.frombuffer(block.data, np.uint8) == 10)
    return keys, line, np.append(np.searchsorted(ends, block.starts), n - 1)


def held_keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    keys, line, first = block_keys(block)
    return keys, np.searchsorted(first, line, side="right") - 1


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what stays, lines joined
    by \\n) and text_sha256. Lines end at \\n only; blank lines stay. A line goes if one
    of its templates stands in at least min_docs rows and the document isn't the one
    with the smallest doc_id among them. Null text counts as empty; doc_id is an integer
    (other types raise TypeError), a null one counts as larger than any other; rows that
    share a doc_id count each, and keep the line alike. Very long texts are read whole. An
    empty table gives no rows. Templates are told apart by 64-bit hashes."""
    packs, buckets = packed(docs)
    wanted = recurring(packs, buckets, held_keys, min_docs, ids=True)

    def cut(docs_: pa.Table, verdicts: pa.Table) -> pa.Table:
        keys, least = answers(verdicts, ("keys", np.uint64), ("ids", np.int64))
        out = {"n_lines": [], "n_dropped": [], "text": [], "text_sha256": []}
        docs_ = in_order(docs_)
        for block in blocks(docs_):
            flat, line, first = block_keys(block)
            owner = np.searchsorted(first, line, side="right") - 1
            there, at = found_in(keys, flat)
            gone = np.zeros(int(first[-1]), bool)
            if len(keys):
                gone[line[there & (least[at] < block.ids[owner])]] = True
            for whole, a, b in zip(block.texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
                bad = gone[a:b]
                kept = whole
                if bad.any():
                    kept = b"\n".join([x for x, g in zip(whole.split(b"\n"), bad.tolist(), strict=True) if not g])
                out["n_lines"].append(b - a)
                out["n_dropped"].append(int(bad.sum()))
                out["text"].append(kept)
                out["text_sha256"].append(hashlib.sha256(kept).hexdigest())
        kinds = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "text": pa.binary(), "text_sha256": pa.string()}
        t = {k: pa.array(v, kinds[k]) for k, v in out.items()}
        return pa.table({"doc_id": docs_.column("doc_id")} | t | {"text": t["text"].cast(pa.string())})

    return packs.groupBy("_pack").cogroup(wanted.groupBy("_pack")).applyInArrow(cut, "doc_id long, n_lines long, n_dropped long, text string, text_sha256 string")
