"""Plain versions of the corpus operators, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(d):
    return float("inf") if d is None else d


def exact(rows):
    """rows: (doc_id, text) -> {index: (keep_id, size, sha)}."""
    groups = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    out = {}
    for content, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), key(rows[i][0])))
        for i in members:
            out[i] = (rows[best][0], len(members), hashlib.sha256(content.encode()).hexdigest())
    return out


def windows(rows, k=13):
    """{index: (n_words, n_removed, sha)}."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = {}
    for n, ((d, _), w) in enumerate(zip(rows, words)):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < key(d):
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[n] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def simhash(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near(rows, distance=2):
    """[(fingerprint, component id)]."""
    fps = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, float("inf")), key(d))
    return [(fps[i], None if least[find(i)] == float("inf") else least[find(i)]) for i in range(len(rows))]


def top(vectors, every=50, k=5):
    """vectors: {id: ints or None} -> {(query, rank): (id, score)}."""
    ok = {i: v for i, v in vectors.items() if v is not None}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok.items() if i != q))[:k]
            for r, (s, i) in enumerate(scored, 1):
                out[q, r] = (i, -s)
    return out


def template(token):
    return "<*>" if len(token.encode()) >= 40 or re.search(r"[0-9@\\\\]|://", token) else token


def alike(a, b):
    """Whether two lines are of one template: equal but for variable fields, or, if long,
    but for one of four runs of the tokens after the third."""
    if len(a) != len(b) or not a or a[:3] != b[:3]:
        return False
    if a == b:
        return True
    if len(a) < 12:
        return False
    x, y = a[3:], b[3:]
    cut = [len(x) * i // 4 for i in range(5)]
    return sum(x[i:j] != y[i:j] for i, j in zip(cut, cut[1:])) == 1


def lines(rows, least=3):
    """[kept text] for each row. A template with a free run counts the rows that have a
    line of it, so the rule is written on the templates that a line is of."""
    def forms(line):
        t = tuple(template(x) for x in WORD.findall(line))
        if not t:
            return []
        out = [("whole", t)]
        if len(t) >= 12:
            x = t[3:]
            cut = [len(x) * i // 4 for i in range(5)]
            out += [(i, len(t), t[:3] + x[: cut[i]], x[cut[i + 1] :]) for i in range(4)]
        return out

    docs, first = defaultdict(int), {}
    for d, t in rows:
        for g in {k for x in (t or "").split("\n") for k in forms(x)}:
            docs[g] += 1
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, t in rows:
        bad = lambda x: any(docs[k] >= least and first[k] < key(d) for k in forms(x))
        out.append("\n".join(x for x in (t or "").split("\n") if not bad(x)))
    return out
