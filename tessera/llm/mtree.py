"""Exact top-k inner products by best-first search in an M-tree.

Adding one coordinate turns the largest inner product into the smallest Euclidean
distance: with R the greatest length of a stored vector, x gets sqrt(R^2 - |x|^2) and
a query gets 0, so |q - x|^2 = |q|^2 + R^2 - 2 q.x. The tree holds pages of entries; an
entry above the leaves is a routing object with the covering radius of what lies
below it and its distance to the routing object of its own page. |d(q, parent) -
d(parent, entry)| and the radius bound an entry's score before its own distance is
computed. Each query takes the leaf with the largest possible score first; queries that
take the same leaf are scored by one matrix product, in exact integers.

The rows are ordered by their nearest of a bounded number of pivots and by the distance
to it, and that order is cut into subtrees of bounded size, so that a subtree covers a
small ball; equal vectors spread over as many subtrees as they fill. Roots of subtrees
are gathered into pages of the levels above, until the topmost level fits a bound in
bytes. A query first searches the pivots and the subtree that it lies in, which gives it
a floor: its k-th best score so far. Then it descends from the top, one Spark join for each level,
and only pairs of a query and a page that the floor can't rule out are sent on."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

SCALE, TOP, EVERY = 256, 5, 50
#: Vectors in a subtree, entries in a page of it, queries in a block.
TREE, PAGE, BLOCK = 4096, 128, 512
#: Rows that route the others to subtrees and give the queries their first floors.
PIVOTS = 256
#: Entries of a page above the subtrees, and bytes of the topmost level, which every task gets.
FAN, TOPMOST_BYTES = 512, 4 << 20
NEVER = np.iinfo(np.int64).min


def quantised(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and v = floor(256 * x) of each component as a long; rows with a null
    vec_id, a null vector or a component that is null or not finite are left out."""
    x = F.col(vec)
    sound = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return df.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter rows are filled up with zeros."""
    flat, cuts = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    size = np.diff(cuts)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), -1).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    cuts = cuts - cuts[0]
    for i, n in enumerate(size.tolist()):
        out[i, :n] = flat[cuts[i] : cuts[i] + n]
    return out


def _narrow(v: np.ndarray) -> np.ndarray:
    """The integers in the smallest type that holds them, for shipping."""
    most = int(np.abs(v).max(initial=0))
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _exact(a: int, b: int, width: int) -> bool:
    """Whether sums of `width` products of integers up to a and b are exact as doubles."""
    return a * b * max(width, 1) < 1 << 52


class Bounds:
    """Largest possible scores of queries (integers, one row each) at given distances."""

    def __init__(self, queries: np.ndarray, reach: float, width: int) -> None:
        self.q = np.zeros((len(queries), width + 1))
        w = min(width, queries.shape[1])
        self.q[:, :w] = queries[:, :w]
        square = (self.q**2).sum(1)
        self.base = square + reach
        self.slack = 1e-6 * (1 + np.sqrt(square)) + 1e-12 * self.base

    def most(self, of: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Rounded up; of: the query that each distance belongs to."""
        d = np.maximum(distance, 0)
        base, slack = self.base[of], self.slack[of]
        if d.ndim > base.ndim:
            base, slack = base[:, None], slack[:, None]
        return np.floor((base - d * d) / 2 + slack) + 1

    def distance(self, of: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.q[of] - centres, axis=1)


class MTree:
    """ids and vectors (integers, one row each), in an order that puts each leaf page
    together. levels[0] are the leaf pages; levels[i] has for each page: first and
    end (of entries below), centre (an augmented vector), radius and parent distance.
    reach: the square of R; by default that of the own vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, reach: float | None = None) -> None:
        length = (vectors.astype(np.float64) ** 2).sum(1)
        self.reach = float(length.max(initial=0.0)) if reach is None else reach
        full = np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(self.reach - length, 0))[:, None]])
        order, cuts = self._pages(full, ids, page)
        self.ids, self.width = ids[order], vectors.shape[1]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.vectors = _narrow(vectors[order])
        full = full[order]
        self.levels, below = [], np.stack([cuts[:-1], cuts[1:]], 1)
        centre = np.array([full[a:b].mean(0) for a, b in below])
        self.leaf_parent = np.concatenate([np.linalg.norm(full[a:b] - c, axis=1) for (a, b), c in zip(below, centre, strict=True)])
        radius = np.array([self.leaf_parent[a:b].max() for a, b in below])
        while True:
            self.levels.append({"below": below, "centre": centre, "radius": radius, "parent": np.zeros(len(centre))})
            if len(centre) == 1:
                break
            below, up, gap, radius = _above(centre, radius, page)
            self.levels[-1]["parent"] = gap
            centre = up

    @staticmethod
    def _pages(full: np.ndarray, ids: np.ndarray, page: int) -> tuple[np.ndarray, np.ndarray]:
        """Halves the rows by the nearer of two far pivots (balanced at the median, so
        equal vectors can't fill one side) until each part fits a page."""
        order, cuts, work = np.argsort(ids, kind="stable"), [], [(0, len(ids))]
        while work:
            a, b = work.pop()
            if b - a <= page:
                cuts.append(a)
                continue
            rows = full[order[a:b]]
            p = rows[np.linalg.norm(rows - rows.mean(0), axis=1).argmax()]
            q = rows[np.linalg.norm(rows - p, axis=1).argmax()]
            side = rows @ (q - p)
            order[a:b] = order[a:b][np.argsort(side, kind="stable")]
            mid = a + max(page, (b - a) // 2 // page * page)
            work += [(mid, b), (a, mid)]
        return order, np.append(cuts, len(ids))

    def _leaves(self, b: Bounds, floors: np.ndarray) -> tuple[np.ndarray, ...]:
        """The leaf pages that each query may have to visit: query, page, bound, distance."""
        top = self.levels[-1]
        of, node = np.arange(len(b.q)), np.zeros(len(b.q), np.int64)
        d = b.distance(of, top["centre"][node])
        self.seen += len(of)
        bound = b.most(of, d - top["radius"][node])
        for level in range(len(self.levels) - 1, 0, -1):
            ok = bound >= floors[of]
            of, node, d = of[ok], node[ok], d[ok]
            span = self.levels[level]["below"][node]
            n = span[:, 1] - span[:, 0]
            kid = np.repeat(span[:, 0] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            of, d = np.repeat(of, n), np.repeat(d, n)
            down = self.levels[level - 1]
            # the stored distance to the parent rules entries out before theirs is computed
            ok = b.most(of, np.abs(d - down["parent"][kid]) - down["radius"][kid]) >= floors[of]
            of, node = of[ok], kid[ok]
            d = b.distance(of, down["centre"][node])
            self.seen += len(of)
            bound = b.most(of, d - down["radius"][node])
        return of, node, bound, d

    def search_block(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (one row for each query, best first, ties to the smaller id; NEVER
        where there are fewer) of the k best entries, without those of id `own` and those
        under the floors. self.seen counts the distances and scores that it computed."""
        m = len(queries)
        best, who = np.full((m, k), NEVER), np.full((m, k), np.iinfo(np.int64).max)
        self.seen = 0
        if not len(self.ids) or not m:
            return best, who
        width = min(queries.shape[1], self.width)
        plain = _exact(self.largest, int(np.abs(queries).max(initial=0)), width)
        kind = np.float64 if plain else np.int64
        mine, floors = queries[:, :width].astype(kind), floors.astype(np.float64).copy()
        b = Bounds(queries, self.reach, self.width)
        of, node, bound, d = self._leaves(b, floors)
        order = np.lexsort((-bound, of))
        of, node, bound, d = of[order], node[order], bound[order], d[order]
        first = np.searchsorted(of, np.arange(m))
        turn = np.arange(len(of)) - first[of]
        for r in range(int(turn.max(initial=-1)) + 1):  # each query's leaves, the best first
            now = np.flatnonzero((turn == r) & (bound >= floors[of]))
            if not len(now):
                break
            now = now[np.argsort(node[now], kind="stable")]
            cuts = np.append(np.flatnonzero(np.append(True, node[now][1:] != node[now][:-1])), len(now))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                at = now[x:y]
                lo, hi = self.levels[0]["below"][node[at[0]]]
                qs = of[at]
                need = (b.most(qs, np.abs(d[at][:, None] - self.leaf_parent[None, lo:hi])) >= floors[qs][:, None]).any(0)
                rows, ids = self.vectors[lo:hi, :width][need], self.ids[lo:hi][need]
                if not len(ids):
                    continue
                self.seen += len(ids) * len(qs)
                score = mine[qs] @ rows.astype(kind).T
                score = np.rint(score).astype(np.int64) if plain else score
                score[ids[None, :] == own[qs][:, None]] = NEVER
                self._merge(best, who, floors, qs, score, ids, k)
        return best, who

    @staticmethod
    def _merge(best: np.ndarray, who: np.ndarray, floors: np.ndarray, qs: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> None:
        kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(qs), NEVER)
        for j, q in enumerate(qs.tolist()):
            least = max(float(kth[j]), floors[q])
            pick = np.flatnonzero((score[j] >= least) & (score[j] > NEVER))
            if not len(pick):
                continue
            s, i = np.concatenate([best[q], score[j, pick]]), np.concatenate([who[q], ids[pick]])
            order = np.lexsort((i, ~s))[:k]  # ~s falls as s grows, and never overflows
            best[q], who[q] = s[order], i[order]
            if best[q, -1] > NEVER:
                floors[q] = max(floors[q], float(best[q, -1]))

    def search(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) for one query."""
        best, who = self.search_block(query[None, :], np.array([own]), k, np.array([least]))
        return [(s, i) for s, i in zip(best[0].tolist(), who[0].tolist(), strict=True) if s > NEVER]


def _above(centre: np.ndarray, radius: np.ndarray, page: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pages over entries that lie next to each other: their entries, centres, the distance
    of each entry to the centre of its page, and covering radii."""
    cuts = np.append(np.arange(0, len(centre), page), len(centre))
    below = np.stack([cuts[:-1], cuts[1:]], 1)
    up = np.array([centre[a:b].mean(0) for a, b in below])
    gap = np.concatenate([np.linalg.norm(centre[a:b] - c, axis=1) for (a, b), c in zip(below, up, strict=True)])
    return below, up, gap, np.array([(gap[a:b] + radius[a:b]).max() for a, b in below])


def _nearest(pivots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the squared distance to it."""
    width = max(pivots.shape[1], rows.shape[1])
    p, r = (np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1]))) for x in (pivots, rows))
    gap = (r**2).sum(1)[:, None] - 2 * r @ p.T + (p**2).sum(1)[None, :]
    at = gap.argmin(1)
    return at, np.maximum(gap[np.arange(len(at)), at], 0)


def _routed(base: DataFrame, pivots: np.ndarray, partitions: int) -> DataFrame:
    """The rows by nearest pivot and distance, range-partitioned."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            at, gap = _nearest(pivots, _matrix(b.column("v"))) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("ask"), pa.array(at), pa.array(gap)], names=["vec_id", "v", "ask", "route", "gap"])

    routed = base.select("vec_id", "v", "ask").mapInArrow(run, "vec_id long, v array<long>, ask boolean, route long, gap double")
    order = ["route", "gap", "vec_id"]
    return routed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("vec_id", "v", "ask")


def _floors(pivots: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """For each query its k-th best score among the pivots with another id, a little
    rounded down; minus infinity if there are fewer. With inner products the best rows may
    be long ones far away, which the query's own subtree doesn't tell of."""
    if len(ids) <= k:
        return np.full(len(rows), -np.inf)
    width = min(pivots.shape[1], rows.shape[1])
    score = rows[:, :width].astype(np.float64) @ pivots[:, :width].astype(np.float64).T
    score[own[:, None] == ids[None, :]] = -np.inf
    kth = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
    return kth - 1e-12 * np.linalg.norm(rows.astype(np.float64), axis=1) * np.linalg.norm(pivots.astype(np.float64), axis=1).max() - 1


def _gathered(stream: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, vectors and question marks of `size` rows at a time."""
    held, parts = 0, []
    for b in stream:
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, size - held)
            parts.append((part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)))
            held, lo = held + part.num_rows, lo + part.num_rows
            if held >= size:
                yield _stacked(parts)
                held, parts = 0, []
    if held:
        yield _stacked(parts)


def _stacked(parts: list) -> tuple[np.ndarray, ...]:
    width = max(r.shape[1] for _, r, _ in parts)
    ids, rows, asks = zip(*parts, strict=True)
    return np.concatenate(ids), np.vstack([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]), np.concatenate(asks)


#: Queries on their way: the subtree that they come from, ids, vectors, floors.
Ask = tuple[int, np.ndarray, np.ndarray, np.ndarray]
_FOUND = "found array<struct<query_id:long,vec_id:long,score:long>>"
_ROUTE = "at long, centre array<double>, radius double"


def _answers(ids: np.ndarray, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ok = best > NEVER
    return np.repeat(ids, ok.sum(1)), who[ok], best[ok]


def _subtrees(routed: DataFrame, size: int, page: int, block: int, k: int, reach: float, pivot_ids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """One row for each subtree: at, its routing object (centre, radius), the subtree itself,
    and its queries in blocks, with what they found in it and the floors they got."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for ids, rows, asks in _gathered(stream, size):
            tree, at = MTree(ids, rows, page, reach), task << 32 | n
            n += 1
            mine, blocks, found = np.flatnonzero(asks), [], []
            for lo in range(0, len(mine), block):
                part = mine[lo : lo + block]
                floors = _floors(pivots, pivot_ids, ids[part], rows[part], k)
                best, who = tree.search_block(rows[part], ids[part], k, floors)
                floors = np.maximum(floors, np.where(best[:, -1] > NEVER, best[:, -1].astype(np.float64), -np.inf))
                blocks.append(pickle.dumps((at, ids[part], _narrow(rows[part]), floors), 5))
                found += [{"query_id": q, "vec_id": v, "score": s} for q, v, s in zip(*(x.tolist() for x in _answers(ids[part], best, who)), strict=True)]
            root = tree.levels[-1]
            cols = [pa.array([at], pa.int64()), pa.array([root["centre"][0].tolist()], pa.list_(pa.float64())), pa.array([float(root["radius"][0])]), pa.array([pickle.dumps(tree, 5)], pa.binary()), pa.array([blocks], pa.list_(pa.binary())), pa.array([found], pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=["at", "centre", "radius", "tree", "blocks", "found"])

    return settle(routed.mapInArrow(run, f"{_ROUTE}, tree binary, blocks array<binary>, {_FOUND}"))


def _pages_over(level: DataFrame, entries: int, fan: int) -> DataFrame:
    """Pages over the routing objects of a level: at, centre, radius, and the entries."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        rows = [(r["at"], r["centre"], r["radius"]) for b in stream for r in b.to_pylist()]  # about `fan` roots
        for lo in range(0, len(rows), fan):
            at, centre, radius = zip(*rows[lo : lo + fan], strict=True)
            width = max(map(len, centre))
            centre, radius = np.array([list(c[:-1]) + [0.0] * (width - len(c)) + [c[-1]] for c in centre]), np.array(radius)
            _, up, gap, cover = _above(centre, radius, fan)
            blob = pickle.dumps((np.array(at, np.int64), centre, radius, gap, up[0]), 5)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([up[0].tolist()], pa.list_(pa.float64())), pa.array([float(cover[0])]), pa.array([blob], pa.binary())], names=["at", "centre", "radius", "page"])
            n += 1

    # the order of `at` is that of the routes: neighbours share a page
    dealt = level.repartitionByRange(max(1, -(-entries // fan)), "at").sortWithinPartitions("at")
    return settle(dealt.mapInArrow(run, f"{_ROUTE}, page binary"))


def _passed(ask: Ask, at: np.ndarray, centre: np.ndarray, radius: np.ndarray, gap: np.ndarray | None, up: np.ndarray | None, reach: float, last: bool) -> Iterator[tuple[int, bytes]]:
    """The entries of a page that some of the queries may have to visit, each with those."""
    home, ids, rows, floors = ask
    b = Bounds(rows.astype(np.int64), reach, centre.shape[1] - 1)
    of, node = (x.ravel() for x in np.meshgrid(np.arange(len(ids)), np.arange(len(at)), indexing="ij"))
    if up is not None:
        to_page = np.linalg.norm(b.q - up[None, :], axis=1)
        ok = b.most(of, np.abs(to_page[of] - gap[node]) - radius[node]) >= floors[of]
        of, node = of[ok], node[ok]
    for lo in range(0, len(of), 1 << 16):
        x, y = of[lo : lo + (1 << 16)], node[lo : lo + (1 << 16)]
        ok = b.most(x, b.distance(x, centre[y]) - radius[y]) >= floors[x]
        x, y = x[ok], y[ok]
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        cuts = np.append(np.flatnonzero(np.append(True, y[1:] != y[:-1])), len(y)) if len(y) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            to = int(at[y[i]])
            if not (last and to == home):
                yield to, pickle.dumps((home, ids[x[i:j]], rows[x[i:j]], floors[x[i:j]]), 5)


def _sent(pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["at", "ask"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["at", "ask"])


def _descend(asks: DataFrame, pages: DataFrame, reach: float, last: bool) -> DataFrame:
    """Queries at pages, sent on to the entries of those."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            for b in stream:
                for blob, ask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield from _passed(pickle.loads(ask), *pickle.loads(blob), reach, last)

        yield from _sent(pairs())

    return asks.join(pages.select("at", "page").hint("merge"), "at").select("page", "ask").mapInArrow(run, "at long, ask binary")


def asked_pairs(trees: DataFrame, reach: float, width: int, fan: int = FAN, topmost: int = TOPMOST_BYTES) -> DataFrame:
    """at, ask: which queries have to visit which subtree beside their own."""
    levels, level = [], trees.select("at", "centre", "radius")
    n = level.count()
    while n > 1 and n * 8 * (width + 2) > topmost:
        levels.append(_pages_over(level, n, fan))
        level = levels[-1].select("at", "centre", "radius")
        before, n = n, level.count()
        if n >= before:
            break
    top = level.orderBy("at").collect() if n * 8 * (width + 2) <= max(topmost, 16 * 8 * (width + 2)) else None
    if top is None:  # pages of a single entry: the width alone exceeds the bound
        raise ValueError(f"vectors of {width} components need a larger bound for the topmost level")
    last = not levels
    route = (np.array([r.at for r in top], np.int64), np.array([list(r.centre[:-1]) + [0.0] * (width + 1 - len(r.centre)) + [r.centre[-1]] for r in top]).reshape(len(top), width + 1), np.array([r.radius for r in top]))
    shared = trees.sparkSession.sparkContext.broadcast(route)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(x for b in stream for ask in b.column(0).to_pylist() for x in _passed(pickle.loads(ask), *shared.value, None, None, reach, last))

    asks = trees.select(F.explode("blocks").alias("ask")).mapInArrow(run, "at long, ask binary")
    for i, pages in enumerate(reversed(levels)):
        asks = _descend(asks, pages, reach, i == len(levels) - 1)
    return asks


def top_products(vectors: DataFrame, is_query: "F.Column", k: int = TOP, tree: int = TREE, block: int = BLOCK, page: int = PAGE, fan: int = FAN, topmost: int = TOPMOST_BYTES) -> DataFrame:
    """vectors: vec_id long, v array<long> (see quantised). For each row where is_query
    holds: its k highest scores among all rows with another vec_id (all of them, if
    fewer), ties to the smaller vec_id. Returns query_id, rank, vec_id, score. A
    vector that lacks components counts as if they were zero. Repeated rows are
    ranked as they stand; a repeated query id is answered once, for its least vector. An
    empty table gives no rows."""
    ask = F.coalesce(is_query, F.lit(False))
    once = vectors.where(ask).withColumn("ask", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) == 1)
    base = settle(vectors.where(~ask).withColumn("ask", F.lit(False)).unionByName(once))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = base.agg(F.count("*").alias("n"), F.max(square).alias("reach"), F.max(F.size("v")).alias("width")).first()
    reach, width = (size.reach or 0.0) * (1 + 1e-12), size.width or 0
    # distinct ids: a repeated row must not lift a floor over what other rows can reach
    sample = list({r.vec_id: r for r in base.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()}.values())
    pivots = _matrix(pa.array([list(r.v) for r in sample], pa.list_(pa.int64()))) if sample else np.zeros((1, 0), np.int64)
    pivot_ids = np.array([r.vec_id for r in sample], np.int64)
    if sample:  # pivots that are near each other are neighbours in the order, too
        order, _ = MTree._pages(pivots.astype(np.float64), np.arange(len(pivots)), 1)
        pivots, pivot_ids = pivots[order], pivot_ids[order]
    trees = _subtrees(_routed(base, pivots, max(1, -(-size.n // tree))), tree, page, block, k, reach, pivot_ids, pivots)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for b in stream:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != at:  # rows of a subtree follow each other
                    at, index = b.column(0)[i].as_py(), pickle.loads(b.column(1)[i].as_py())
                _, ids, rows, floors = pickle.loads(b.column(2)[i].as_py())
                got = _answers(ids, *index.search_block(rows.astype(np.int64), ids, k, floors))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["query_id", "vec_id", "score"])

    # no broadcast: what is asked grows with the queries, which the optimizer can't see
    asked = asked_pairs(trees, reach, width, fan, topmost)
    other = asked.join(trees.select("at", "tree").hint("merge"), "at").select("at", "tree", "ask").mapInArrow(run, "query_id long, vec_id long, score long")
    found = trees.select(F.inline("found")).unionByName(other)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    return top_products(quantised(embeddings), F.col("vec_id") % every == 0, k)


OP1_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
