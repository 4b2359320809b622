"""SimHash near-duplicates by a Gray-order hierarchical index.

Equal fingerprints are merged first. Two fingerprints within d bits agree wholly in
two of d + 2 blocks, so each distinct fingerprint is dealt to one group for every
pair of blocks. In a group the fingerprints are sorted by Gray rank and cut into
pages; a node of the index holds the bits that all below it share, without those
that nodes above hold already. A search adds up differences from the top and drops
a whole node once they pass d. A group hands on a spanning forest of its links, never
its pairs; components of the forests over all groups are the result.

near_copies() is the form for a similarity of shingle sets. At a Jaccard similarity of
0.8 two fingerprints differ in about 15 of 100 bits, far beyond what blocks of the
fingerprint can deal out. There fingerprints are longer, and the bits with the clearest
majorities, which near copies seldom tell apart, deal them out: once for each of several
rotations of the counts behind the fingerprint. One Gray-order index over a run of
groups finds the links in each. A group hands on who is linked with whom as one row for
each member; a set is offered with two others of all groups, and whatever the links
checked on whole sets of shingles leave apart is compared in small parts and crowds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, numbered_columns, settle, text_bytes, window_hashes, word_bounds, word_hashes
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
BITS = 64
#: Distinct fingerprints in a group beyond which the group is dealt out again by
#: pairs of blocks of its remaining bits.
HOT_GROUP = 2048
PAGE, FAN = 16, 8


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, and only \x20\x09-\x0D part words
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = ends - size + 1
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    h = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    n, counts = len(h), np.zeros(BITS, np.int64)
    for lo in range(0, n, 8192):
        counts += np.unpackbits(h[lo : lo + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a signed long) for every document."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {key}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over patterns sorted by Gray rank; with groups (ascending numbers),
    by group and rank: then only patterns of one group are linked."""

    def __init__(self, patterns: np.ndarray, page: int = PAGE, fan: int = FAN, group: np.ndarray | None = None) -> None:
        group = np.zeros(len(patterns), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(patterns), group))
        self.leaf = patterns[self.order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        many = np.diff(np.append(first, len(group)))
        self.ends, self.longest = np.repeat(first + many, many), int(many.max())
        self.page, self.fan, self.levels = page, fan, []
        step = page
        ones, zeros = self.leaf, ~self.leaf
        while True:
            cuts = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append([ones | zeros, ones])
            if len(ones) == 1:
                break
            step = fan
        for i in range(len(self.levels) - 1):  # bits of the node above are counted there
            above = self.levels[i + 1][0]
            self.levels[i].append(self.levels[i][0] & ~np.repeat(above, fan)[: len(self.levels[i][0])])
        self.levels[-1].append(self.levels[-1][0])

    def links(self, distance: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places a < b in self.leaf of all patterns within the distance."""
        n, ends = len(self.leaf), self.ends
        top = next((i for i in range(len(self.levels)) if self.page * self.fan**i >= self.longest), len(self.levels) - 1)
        for lo in range(0, n, block):
            q = np.arange(lo, min(n, lo + block))
            q = q[q + 1 < ends[q]]
            # a group meets at most two nodes of the level where the search begins
            span = self.page * self.fan**top
            node = (q[:, None] + 1) // span + np.arange(2)
            keep = node * span < ends[q][:, None]
            q, node = np.repeat(q, keep.sum(1)), node[keep]
            off = np.zeros(len(q), np.int64)
            for level in range(top, -1, -1):
                shared, ones, own = self.levels[level]
                if level < top:
                    kids = node[:, None] * self.fan + np.arange(self.fan)
                    span = self.page * self.fan**level
                    keep = (kids * span < ends[q][:, None]) & ((kids + 1) * span > q[:, None] + 1)
                    q, off, node = np.repeat(q, keep.sum(1)), np.repeat(off, keep.sum(1)), kids[keep]
                off = off + np.bitwise_count((self.leaf[q] ^ ones[node]) & (shared if level == top else own)[node])
                keep = off <= distance
                q, off, node = q[keep], off[keep], node[keep]
            for at in range(0, len(q), 1 << 17):
                a = q[at : at + (1 << 17)]
                b = node[at : at + (1 << 17), None] * self.page + np.arange(self.page)
                ok = (b < ends[a][:, None]) & (b > a[:, None])
                a, b = np.repeat(a, ok.sum(1)), b[ok]
                near = np.bitwise_count(self.leaf[a] ^ self.leaf[b]) <= distance
                yield a[near], b[near]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the representative of each place's part, after the parts of a and b are joined."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(patterns: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct patterns: those linked to another, and the representative (one
    of them) of the part that each is in."""
    index = GrayIndex(patterns)
    root = np.arange(len(patterns))
    for a, b in index.links(distance):
        root = joined(root, a, b)
    child = np.flatnonzero(root != np.arange(len(root)))
    return index.leaf[child], index.leaf[root[child]]


def _block(x: "F.Column", shift: int, width: int) -> "F.Column":
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(x: "F.Column", places: list[tuple[int, int]], keep: int) -> "F.Column":
    """Array of (which, bits): for each choice of `keep` blocks, the bits in them."""
    out = []
    for which, chosen in enumerate(combinations(places, keep)):
        bits = F.lit(0).cast("long")
        for shift, width in chosen:
            bits = bits * F.lit(1 << width) + _block(x, shift, width)
        out.append(F.struct(F.lit(which).cast("long").alias("which"), bits.alias("bits")))
    return F.array(*out)


def _places(shifts: list[tuple[int, int]], blocks: int) -> list[tuple[int, int]]:
    """Cuts runs of bits, given as (shift, width), into about `blocks` blocks of
    whole runs or parts of runs."""
    total = sum(w for _, w in shifts)
    size, out = max(1, total // blocks), []
    for shift, width in shifts:
        n = max(1, round(width / size))
        edges = [width * i // n for i in range(n + 1)]
        out += [(shift + lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    return out


def link_forest(distinct: DataFrame, distance: int = DISTANCE, hot: int = HOT_GROUP) -> DataFrame:
    """distinct: column fp, distinct longs. Edges a, b whose components are those of
    all links within the distance."""
    if not 0 < distance <= 6:
        raise ValueError("distance must be 1 to 6")
    blocks = _places([(0, BITS)], distance + 2)
    base = settle(distinct.select("fp", F.explode(_keys(F.col("fp"), blocks, 2)).alias("k")).select("fp", "k.which", "k.bits"))
    crowded = settle(base.groupBy("which", "bits").count().where(F.col("count") > hot).select("which", "bits", F.lit(True).alias("crowded")))
    whole = lambda df: df.select("fp", F.col("which").alias("g1"), F.col("bits").alias("g2"), F.lit(-1).cast("long").alias("g3"), F.lit(0).cast("long").alias("g4"))
    if crowded.isEmpty():
        groups = whole(base)
    else:
        marked = settle(base.join(crowded, ["which", "bits"], "left"))
        finer = None
        for which, chosen in enumerate(combinations(blocks, 2)):
            rest = _places([b for b in blocks if b not in chosen], distance + 2)
            keys = _keys(F.col("fp"), rest, len(rest) - distance)
            finer = F.when(F.col("which") == which, keys) if finer is None else finer.when(F.col("which") == which, keys)
        dense = marked.where("crowded").select("fp", "which", "bits", F.explode(finer).alias("k")).select("fp", F.col("which").alias("g1"), F.col("bits").alias("g2"), F.col("k.which").alias("g3"), F.col("k.bits").alias("g4"))
        groups = whole(marked.where("crowded is null")).union(dense)
    key = ["g1", "g2", "g3", "g4"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, (*_, fp) in whole_groups(stream, key, ["fp"]):
            cuts = np.append(start, len(fp))
            found = [forest(fp[cuts[i] : cuts[i + 1]].view(np.uint64), distance) for i in np.flatnonzero(np.diff(cuts) > 1).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], names=["a", "b"])

    return groups.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def whole_groups(stream: Iterator[pa.RecordBatch], keys: list[str], others: list[str], rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """From rows sorted by the keys: columns of about `rows` rows, never part of a group, and
    where the groups start. A task holds that much and its largest group, not its partition."""
    names, held, n = keys + others, [], 0

    def starts(cols: list[np.ndarray]) -> np.ndarray:
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[: len(keys)]])) if len(cols[0]) else np.zeros(0, bool)
        return np.flatnonzero(new)

    for b in stream:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += b.num_rows
        if n < rows:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        start = starts(cols)
        cut = int(start[-1])
        if cut:
            yield start[:-1], [c[:cut] for c in cols]
        held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if n:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield starts(cols), cols


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that it
    reaches over links between fingerprints within the distance, itself included).
    Null and empty texts have fingerprint zero and link like any other. A null doc_id
    reaches the component of its fingerprint; if all doc_ids there are null, so is
    component_id. Repeated rows come out repeated. An empty table gives no rows."""
    marks = settle(fingerprints(docs))
    first = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(link_forest(first.select("fp"), distance))
    linked = root.join(first, root.node == first.fp).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = first.join(linked.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    of_fp = settle(of_fp)  # so that the join below reads two plain exchanges and AQE may split a fingerprint that very many rows have
    return marks.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp") -> "F.Column":
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: What near_copies() takes: words of a shingle, Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8
#: Bits whose majorities are counted for a set; the fingerprint has the first 64 * LANES of them.
COUNTED, LANES = 256, 3
#: Bits in which the first 64 and all bits of two fingerprints at that similarity may differ,
#: and all bits where a set has fewer than FEW hashes. Each bit differs with a probability of
#: about 0.15 (0.19 in sets of four and five), so more than so many do with one of about 1e-6
#: or less; independent sets differ in 96 bits, give or take 7.
WITHIN, WIDE, WIDE_FEW, FEW = 28, 55, 64, 16
#: Rotations of the counts, and parts of each. A key is the place and the sign of the largest
#: count in either part, 16 bits; sets of similarity 0.8 have it in common with a probability
#: of 0.17, so they share none of all keys with 3e-8 (chance in the counts raises that to
#: about 1e-6).
ROTATIONS, HALVES = 96, 2
#: Bits of all in which the fingerprints of a set and the least of its clear links differ.
CLEAR = 24
#: Sets in a part of a group, linked by their fingerprints, up to which all its pairs are
#: offered, if they are apart (63 at most).
SMALL = 8
#: Sets in a group beyond which it is dealt over several tasks.
LARGE = 1024
#: Single minimum hashes that deal out the members of large parts; sets and shingles of a
#: block there, whichever is reached first.
ALONE, CROWD, CROWD_SHINGLES = 10, 2048, 2 << 20
_ODD = mix64(np.arange(1, ALONE + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mix64(np.arange(2001, 2001 + ALONE, dtype=np.uint64))
_LANE = mix64(np.arange(3001, 3001 + COUNTED // 64, dtype=np.uint64))
_SIGNS = np.unpackbits(mix64(np.arange(4001, 4001 + ROTATIONS * COUNTED // 64, dtype=np.uint64)).view(np.uint8)).reshape(ROTATIONS, COUNTED).astype(np.float32) * 2 - 1
_SIDE = 16
#: Hadamard matrix of a side: rows and columns of the counts as a square are turned by it.
_TURN = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(_SIDE)] for i in range(_SIDE)], np.float32)


def shingles(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; a
    shorter text is one shingle, a text without words has none."""
    low = text.lower()
    words = word_hashes(low, *word_bounds(low))
    return np.unique(window_hashes(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def node_of(found: np.ndarray) -> int:
    """What a set is known by; equal sets have the same."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def majorities(found: np.ndarray) -> np.ndarray:
    """For each counted bit: how many hashes of a set have it, less how many don't."""
    counts = np.zeros(COUNTED, np.int64)
    for lo in range(0, len(found), 8160):
        lanes = mix64(found[lo : lo + 8160, None] ^ _LANE)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        for at in range(0, len(bits), 255):  # so many fit a byte
            counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return counts * 2 - len(found)


def wide_fingerprint(counts: np.ndarray) -> np.ndarray:
    """SimHash of a set from its majorities, as signed longs."""
    return np.packbits(counts[: 64 * LANES] > 0).view(np.int64)


def group_keys(counts: np.ndarray) -> np.ndarray:
    """One key for each rotation: where the clearest majorities are."""
    turned = (counts.astype(np.float32) * _SIGNS).reshape(-1, _SIDE) @ _TURN
    turned = turned.reshape(ROTATIONS, _SIDE, _SIDE).transpose(0, 2, 1).reshape(-1, _SIDE) @ _TURN
    part = turned.reshape(ROTATIONS * HALVES, -1)
    at = np.abs(part).argmax(axis=1)
    code = (at * 2 + (part[np.arange(len(at)), at] > 0)).reshape(ROTATIONS, HALVES)
    key = np.arange(ROTATIONS)
    for i in range(HALVES):
        key = key * (2 * part.shape[1]) + code[:, i]
    return key.astype(np.int32)


_MARKS = ["size", *[f"fp{i}" for i in range(LANES)]]


def sketches(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, size (shingles in the set), the words fp0, fp1, ... of the fingerprint, and
    the keys of the groups for every document; a set too small to be so similar to any but its equals has no keys."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            nodes, sizes, prints, keys = [], [], [], []
            for t in b.column(1):
                found = shingles(t.as_py())
                counts = majorities(found)
                nodes.append(node_of(found))
                sizes.append(len(found))
                prints.append(wide_fingerprint(counts))
                keys.append(group_keys(counts) if len(found) / (len(found) + 1) >= similarity else [])
            lanes = np.array(prints, np.int64).reshape(-1, LANES).T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(x) for x in lanes], pa.array(keys, pa.list_(pa.int32()))], names=["doc_id", "node", *_MARKS, "keys"])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {key}, node long, {', '.join(f'{c} long' for c in _MARKS)}, keys array<int>")


def _pairs(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]


def offers(rows: DataFrame, similarity: float, small: int, large: int = 0) -> DataFrame:
    """rows: key, node, size, fp0, fp1, ... Rows node, key, nears, off, other, low: members of parts. In
    each group of a key a Gray-order index finds the links between fingerprints. Of what they
    join, a part of up to `small` sets goes by a hash of its members, with a bit of nears for
    each following member (by node) that is linked; a larger one is a crowd, goes by its least
    node and has no nears. other is a member's closest link, off bits away, low the least of
    its clear ones. A group of more than `large` sets is dealt by hash into
    parts of about so many, all of one crowd; the first set of each part's largest
    goes into a group of such sets, and so on: no task gets a whole group."""
    large = large or LARGE
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large)
    big = settle(counts.select("key", F.ceil(F.col("n") / large).cast("int").alias("_parts")))
    split = not big.isEmpty()
    dealt = rows.join(big, "key", "left") if split else rows.withColumn("_parts", F.lit(None).cast("int"))
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"), F.lit(-1))
    dealt = dealt.select("key", part.alias("part"), "node", *_MARKS)
    found_columns = ["node", "key", "nears", "off", "other", "low"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*found_columns, *_MARKS]
        none = lambda n, k: [pa.nulls(int(n), pa.int64())] * k
        never = np.iinfo(np.int64).max
        for start, (key, part, node, n, *lanes) in whole_groups(stream, ["key", "part"], ["node", *_MARKS]):
            fp = np.stack(lanes, axis=1).view(np.uint64)

            def near(i: np.ndarray, j: np.ndarray, fp: np.ndarray = fp, n: np.ndarray = n) -> tuple[np.ndarray, np.ndarray]:
                less, more = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                off = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)
                return off, (off <= np.where(less < FEW, WIDE_FEW, WIDE)) & (less / more >= similarity)

            index = GrayIndex(fp[:, 0], group=np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key)))))
            root = np.arange(len(key))
            best, low = np.full(len(key), never), np.full(len(key), never)
            for i, j in index.links(WITHIN, 8192):
                i, j = index.order[i], index.order[j]
                off, ok = near(i, j)
                i, j, off = i[ok], j[ok], off[ok]
                root = joined(root, i, j)
                np.minimum.at(best, i, off << 32 | j)
                np.minimum.at(best, j, off << 32 | i)
                i, j = i[off <= CLEAR], j[off <= CLEAR]
                np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))  # places in a group go by node
            size = np.bincount(root, minlength=len(root))[root]
            linked = np.flatnonzero(size > 1)
            linked = linked[np.argsort(root[linked], kind="stable")]
            of, crowd = root[linked], size > small
            nears = np.zeros(len(key), np.int64)
            for d in range(1, min(small, len(linked))):
                i = np.flatnonzero((of[d:] == of[:-d]) & ~crowd[linked[d:]])
                ok = near(linked[i], linked[i + d])[1]
                nears[linked[i[ok]]] |= 1 << (d - 1)
            dealt_out = part >= 0
            member = (size > 1) | dealt_out
            if member.any():
                named = np.zeros(len(key), np.uint64)
                np.add.at(named, root, mix64(node.view(np.uint64)))
                own = np.where(crowd, node[root], mix64(named)[root].view(np.int64))
                whose = [pa.array(np.where(dealt_out, key, own)[member]), pa.array(nears[member], mask=(crowd | dealt_out)[member])]
                off, other = best >> 32, node[np.where(best < never, best & 0xFFFFFFFF, 0)]
                closest = [pa.array(x[member], mask=(best == never)[member]) for x in (off, other)]
                least = pa.array(node[np.where(low < never, low, 0)][member], mask=(low == never)[member])
                yield pa.RecordBatch.from_arrays([pa.array(node[member]), *whose, *closest, least, *none(member.sum(), len(_MARKS))], names=names)
            if dealt_out.any():
                up = np.array([lo + size[lo:hi].argmax() for lo, hi in zip(start, np.append(start[1:], len(key)), strict=True) if dealt_out[lo]])
                yield pa.RecordBatch.from_arrays([pa.array(node[up]), pa.array(key[up]), *none(len(up), 4), *[pa.array(x[up]) for x in (n, *lanes)]], names=names)

    found = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, ", ".join(f"{c} long" for c in (*found_columns, *_MARKS)))
    if not split:
        return found.select(*found_columns)
    found = settle(found)
    centres = found.where(F.col("size").isNotNull()).select("key", "node", *_MARKS)
    return found.select(*found_columns).union(offers(centres, similarity, small, large))


def between(parts: DataFrame, small: int) -> DataFrame:
    """parts: key, node, nears, root, sure of the members of small parts. Pairs a, b of linked
    members with different roots, unless both are sure to be compared elsewhere."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, node, nears, root, sure) in whole_groups(stream, ["key"], ["node", "nears", "root", "sure"]):
            for d in range(1, min(small, len(key))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (nears[:-d] >> (d - 1) & 1 == 1) & (root[d:] != root[:-d]) & ~(sure[d:] & sure[:-d]))
                if len(i):
                    yield pa.RecordBatch.from_arrays(_pairs(node[i], node[i + d]), names=["a", "b"])

    return parts.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long").distinct()


def _least(found: np.ndarray) -> np.ndarray:
    """Keys of a set: one for each of ALONE minimum hashes."""
    return mix64(mix64((found[:, None] * _ODD).min(axis=0)) + _BAND)


def _tied(tokens: list[np.ndarray], size: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of `left` and of `right` (places) that join different parts, as a
    spanning forest. Shared tokens are counted by matrix products over the tokens that
    several sets have, some thousand at a time; the counts are of whole sets, so every link
    of the forest is one, and none has to be taken out of it later."""
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    token, column, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    ok = shared[column]
    row, column = row[ok], place[column[ok]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        x, y = np.searchsorted(column, [lo, lo + 2048])
        m = np.zeros((len(tokens), 2048), np.float32)
        m[row[x:y], column[x:y] - lo] = 1
        both += m[left] @ m[right].T
    need = similarity / (1 + similarity) * (size[left][:, None] + size[right][None, :])
    i, j = np.nonzero((both >= need - 1e-3) & (root[left][:, None] != root[right][None, :]))
    shared_by = both[i, j].astype(np.float64)
    i, j = left[i], right[j]
    exact = shared_by / (size[i] + size[j] - shared_by) >= similarity
    i, j = i[exact], j[exact]
    names, part = np.unique(root, return_inverse=True)
    part = part.copy()
    out = [np.zeros((2, 0), np.int64)]
    while len(i):
        a, b = part[i], part[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        # one link out of each part, then the parts that they join become one
        _, pick = np.unique(np.minimum(a, b), return_index=True)
        out.append(np.stack([i[pick], j[pick]]))
        up = np.arange(len(names))
        np.minimum.at(up, np.maximum(a[pick], b[pick]), np.minimum(a[pick], b[pick]))
        while (up[up] != up).any():
            up = up[up]
        part = up[part]
    return tuple(np.concatenate(out, axis=1))


def remaining(members: DataFrame, known: DataFrame, similarity: float, block: int = 0) -> DataFrame:
    """members: node, root of the members of crowds that hold several roots; known: node, found.
    A spanning forest a, b of the links between different roots. The members
    are dealt out anew, by ALONE single minimum hashes (a pair at 0.8 shares none of
    them with probability 1e-7), and compared where they meet, with their sets at hand: no
    pairs are sent. A bucket of more than CROWD sets, or CROWD_SHINGLES shingles, is cut into
    blocks, and each pair of blocks is a group of its own, so no task holds more than two."""
    block = block or CROWD
    some = known.join(members.select("node"), "node", "left_semi")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            found = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("found")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([_least(x).view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([len(x) for x in found], pa.int64()), b.column("found")], names=["node", "keys", "size", "tokens"])

    short = settle(some.mapInArrow(cut, "node long, keys array<long>, size long, tokens binary"))
    keyed = short.select("node", "size", F.explode("keys").alias("key")).join(members, "node")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / CROWD_SHINGLES)).cast("int")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", blocks.alias("n"))
    at = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = keyed.join(sizes, "key").select("key", "node", "root", at.alias("at"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    dealt = dealt.select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "at", "node", "root")
    full = dealt.join(short.select("node", "size", "tokens"), "node").select("key", "i", "j", "at", "node", "root", "size", "tokens")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, (_, i, j, at, node, root, size, tokens) in whole_groups(stream, ["key", "i", "j"], ["at", "node", "root", "size", "tokens"], 2048):
            cuts = np.append(start, len(node))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2 or (root[lo:hi] == root[lo]).all():
                    continue
                left, right = np.flatnonzero(at[lo:hi] == i[lo]), np.flatnonzero(at[lo:hi] == j[lo])
                a, b = _tied([np.frombuffer(x, np.uint64) for x in tokens[lo:hi]], size[lo:hi], root[lo:hi], left, right, similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays(_pairs(node[lo + a], node[lo + b]), names=["a", "b"])

    key = ["key", "i", "j"]
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, found: the sets of the given nodes (columns node, first: a doc_id that has it)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            found = [shingles(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "found"])

    ids = nodes.select(F.col("first").alias("_first")).distinct()
    some = docs.select("doc_id", text_bytes().alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    # a doc_id that several rows have brings sets along that aren't wanted, or twice
    return some.select("text").mapInArrow(run, "node long, found binary").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))


def verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose whole sets are as similar as that."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream:
            ok = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / (len(x) + len(y) - both) >= similarity)
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = known.select(F.col("node").alias("a"), F.col("found").alias("x")), known.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id that it reaches over
    links between documents whose sets of five-word shingles have that Jaccard similarity or
    more, itself included). Null, empty and blank texts have equal, empty sets and link with
    each other only. A null doc_id reaches the component of its set; if all doc_ids there are
    null, so is component_id. Repeated rows come out repeated. Very long texts are read whole.
    An empty table gives no rows. Shingles and sets are told apart by 64-bit hashes; a pair at
    the threshold is overlooked with a probability of about 1e-6 and a closer one less often."""
    marks = settle(sketches(docs, similarity))
    first = settle(marks.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in (*_MARKS, "keys")]))
    found = offers(first.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), "node", *_MARKS), similarity, small)
    parts = settle(found.groupBy("node", "key", "nears").agg(F.min(F.when(F.col("other").isNotNull(), F.struct("off", "other"))).alias("closest"), F.min("low").alias("low")))
    nodes = settle(parts.groupBy("node").agg(F.min("closest").alias("closest"), F.min("low").alias("low")))
    known = settle(sets(docs, settle(first.select("node", "first").join(nodes, "node", "left_semi"))))
    offered = nodes.select("node", F.explode(F.array("closest.other", "low")).alias("other")).where("other is not null")
    root = components(verified(offered.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), known, similarity))
    # what is apart is tied at the roots; crowds of several roots are compared as a whole, all other links one by one
    root = settle(nodes.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    rooted = parts.select("node", "key", "nears").join(root, "node")
    mixed = rooted.where("nears is null").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = settle(rooted.where("nears is null").join(mixed, "key", "left_semi").select("node", "root").distinct())
    loose = rooted.where("nears is not null").join(members.select("node", F.lit(True).alias("sure")), "node", "left").fillna(False, ["sure"])
    more = settle(verified(between(loose, small), known, similarity))
    if not members.isEmpty():
        more = settle(more.union(remaining(members, known, similarity)))
    ends = more.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    root = root.join(components(ends).toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    linked = root.join(first.select("node", "first"), "node").select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = first.select("node", "first").join(linked.select("node", "root").join(least, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    of_node = settle(of_node)  # so that AQE may split a set that very many rows have
    return marks.select("doc_id", "node").join(of_node, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the documents whose doc_id names it, and those without
    doc_id whose group has no other; with the columns of docs, whatever their names. Rows
    that repeat such a doc_id stay together. Null and empty texts are one group; an empty
    table stays empty."""
    kept = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    plain, back = numbered_columns(docs, "doc_id")
    return plain.join(kept, plain.doc_id.eqNullSafe(kept._kept), "left_semi").select(*back)
