"""Near copies against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random
import re

import brute
import corpus_pipeline as pipeline
import pytest
from test_corpus_operators import corpus, empty, frame

from tessera.llm import simhash


def shingles(text, k=5):
    w = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) > k else frozenset([tuple(w)] if w else [])


def components(rows, similarity=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) / len(x | y) >= similarity:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), brute.key(d))
    return [None if least[find(i)] == float("inf") else least[find(i)] for i in range(len(rows))]


def near_corpus():
    """Texts of 100 words with one to six words changed, on both sides of the threshold."""
    r = random.Random(3)
    rows = []
    for i in range(30):
        words = [f"v{r.randrange(5000)}" for _ in range(100)]
        for k in range(7):
            changed = list(words)
            for at in r.sample(range(100), k):
                changed[at] = f"x{r.randrange(10**6)}"
            rows.append((10 * i + k, " ".join(changed)))
    return rows


@pytest.mark.parametrize("small", [2, 8])
def test_components_equal_all_pairs(spark, small):
    rows = corpus() + [(1000 + d, t) for d, t in near_corpus()]
    got = sorted((repr(r.doc_id), repr(r.component_id)) for r in simhash.near_copies(frame(spark, rows, True), small=small).collect())
    assert got == sorted((repr(d), repr(c)) for (d, _), c in zip(rows, components(rows)))


def test_near_stage_drops_near_copies(spark):
    rows = near_corpus()
    want = sorted(d for (d, _), c in zip(rows, components(rows)) if d == c)
    assert len(want) < 150
    assert sorted(r.doc_id for r in pipeline.near(spark, frame(spark, rows), "").collect()) == want


@pytest.mark.parametrize(("small", "crowd"), [(2, 2048), (8, 2048), (2, 16)])
def test_large_band(spark, small, crowd, monkeypatch):
    """A band that many sets share: near copies of two texts that have most words in common."""
    monkeypatch.setattr(simhash, "CROWD", crowd)  # the smallest cuts buckets into pairs of blocks
    r = random.Random(11)
    base = [f"v{r.randrange(5000)}" for _ in range(120)]
    other = base[:70] + [f"y{i}" for i in range(50)]
    rows = []
    for i in range(120):
        words = list(base if i % 3 else other)
        for at in r.sample(range(120), 1 + i % 5):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(frame(spark, rows), small=small).collect())
    assert got == sorted((d, c) for (d, _), c in zip(rows, components(rows)))


def test_empty(spark):
    assert simhash.near_copies(empty(spark)).collect() == []


def test_a_forest_holds_only_links():
    """A pair whose halves collide is no link, and doesn't stand in the way of a true one."""
    import numpy as np

    a = np.arange(1, 11, dtype=np.uint64) << np.uint64(32)
    b = np.concatenate([a[:8], [np.uint64(90 << 32), np.uint64(91 << 32)]])  # 8 of 12: 0.667
    b[8] = a[8] | np.uint64(7)  # equal to one of a in its upper half only
    c = np.concatenate([a[:9], [np.uint64(95 << 32)]])  # 9 of 11: 0.818
    sets = [np.unique(x) for x in (a, b, c)]
    size, root, all_ = np.array([len(x) for x in sets]), np.arange(3), np.arange(3)
    i, j = simhash._tied(sets, size, root, all_, all_, 0.8)
    assert {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)} == {frozenset((0, 2))}


@pytest.mark.parametrize("seed", range(20))
def test_forests_join_what_links_join(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 40).astype(np.uint64)
    # equal upper halves everywhere: only whole hashes tell them apart
    sets = [np.unique(np.concatenate([r.choice(base, 30, replace=False), (base[:6] & ~np.uint64(0xFFFFFFFF)) | r.integers(0, 3, 6).astype(np.uint64)])) for _ in range(40)]
    size = np.array([len(x) for x in sets])
    left, right = np.arange(0, 20), np.arange(20, 40)
    i, j = simhash._tied(sets, size, np.arange(40), left, right, 0.7)
    linked = {(x, y) for x in left for y in right if len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y])) >= 0.7}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) <= linked

    def parts(links):
        up = list(range(40))
        for x, y in links:
            a, b = up[x], up[y]
            up = [a if u == b else u for u in up]
        return [up.index(u) for u in up]

    assert parts(zip(i.tolist(), j.tolist(), strict=True)) == parts(linked)


@pytest.mark.parametrize("large", [10, 37])
def test_large_bands_are_dealt_and_lose_nothing(spark, monkeypatch, large):
    """One text of which hundreds of near copies exist, so that its bands are dealt in two
    levels and more."""
    monkeypatch.setattr(simhash, "LARGE", large)
    r = random.Random(9)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(400):
        changed = list(words)
        for at in r.sample(range(200), r.randrange(0, 5)):
            changed[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(changed)))
    rows += [(1000 + d, t) for d, t in near_corpus()]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(frame(spark, rows, False)).collect())
    assert got == sorted(zip([d for d, _ in rows], components(rows), strict=True))


def test_blocks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD_SHINGLES", 500)
    rows = [(1000 + d, t) for d, t in near_corpus()]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(frame(spark, rows, False), small=2).collect())
    assert got == sorted(zip([d for d, _ in rows], components(rows), strict=True))


def test_fingerprints_alone_deal_out_near_copies():
    """Sets of Jaccard similarity 0.8 share a key of their fingerprints' counts and lie within
    the bits that the index searches; independent sets share few keys."""
    import numpy as np

    r = np.random.default_rng(4)
    for n, apart in [(4, 0), (9, 1), (36, 4), (180, 20)]:
        for _ in range(100):
            pool = r.permutation(np.unique(r.integers(0, 1 << 63, 2 * n + apart + 1).astype(np.uint64)))
            a, b = np.sort(pool[:n]), np.sort(pool[apart : n + max(apart, 1)])
            x, y, z = (simhash.majorities(s) for s in (a, b, np.sort(pool[-n:])))
            assert (simhash.group_keys(x) == simhash.group_keys(y)).any()
            off = np.bitwise_count((simhash.wide_fingerprint(x) ^ simhash.wide_fingerprint(y)).view(np.uint64))
            assert off[0] <= simhash.WITHIN and off.sum(dtype=np.int64) <= (simhash.WIDE_FEW if n < simhash.FEW else simhash.WIDE)
            if n > 30:
                assert (simhash.group_keys(x) == simhash.group_keys(z)).sum() <= 12


def test_one_index_searches_many_groups():
    import numpy as np

    r = np.random.default_rng(2)
    group = np.sort(r.integers(0, 60, 700))
    group[:300] = 0  # one that spans many pages
    fp = r.integers(0, 1 << 12, 700).astype(np.uint64)
    index = simhash.GrayIndex(fp, group=group)
    got = {frozenset((int(index.order[i]), int(index.order[j]))) for a, b in index.links(2) for i, j in zip(a, b, strict=True)}
    want = {frozenset((i, j)) for i in range(700) for j in range(i) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("changes", [(0, 4), (4, 12)])
def test_offered_pairs_grow_with_sets_not_with_groups(spark, monkeypatch, changes):
    """Copies of one text, close to each other or mostly below the threshold: each offers
    few pairs, however large the group and whatever keys its members share."""
    counted, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *a: counted.append(pairs.count()) or verified(pairs, *a))
    r = random.Random(5)
    words = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(300):
        changed = list(words)
        for at in r.sample(range(150), r.randint(*changes)):
            changed[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(changed)))
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(frame(spark, rows)).collect())
    assert got == sorted(zip([d for d, _ in rows], components(rows), strict=True))
    assert sum(counted) <= 3 * len(rows), counted
