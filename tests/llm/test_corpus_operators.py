"""Each corpus operator against its plain version, with nulls, empty and long texts,
ties, repeated rows, empty tables and columns whose names clash."""

from __future__ import annotations

import datetime
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import bpe, debruijn, feistel, grace, hilbert, lsa, mixing, mtree, recurring, simhash, templates
from tessera.llm.common import load
from tessera.llm.components import components
from tessera.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(12)] + ["The", "and", "of"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have such columns too.
CLASH = ["_pack", "_sha", "_n", "_kept", "_again", "_rate", "score", "fp", "component_id", "keep_id", "count", "_payload", "tokens", "c0", "_sha256", "_copies", "_slot"]


def corpus(seed=7, n=60):
    """Documents that share long passages, copies, near copies and common lines."""
    r = random.Random(seed)
    passage = [r.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(n):
        w = [r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.6 else "") for _ in range(r.randrange(1, 60))]
        if r.random() < 0.5:
            a = r.randrange(20)
            w[r.randrange(len(w)) :] = passage[a : a + r.randrange(10, 30)]
        text = "".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in w)
        if r.random() < 0.3:
            text = "Common line number one\n" + text + "\nCopyright 2020 by all, version 3."
        rows.append((i, text))
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # copies
    rows += [(120 + i, " " + rows[0][1] + " " * i) for i in range(5)]  # equal but for blanks
    rows += [(150, None), (151, ""), (152, " \n "), (None, "w1 w2 w3"), (None, None), (160, "And " * 3000), (161, "x" * 200_000), (162, "And " * 3000 + "end")]
    rows += [(5, rows[5][1]), (6, "another text under a known id")]  # repeated rows and ids
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(d, t, None if d == 3 else "en", f"src{(d or 0) % 3}", len(t) if t else None) for d, t in rows], SCHEMA).repartition(5)
    if clash:
        for c in CLASH:
            df = df.withColumn(c, F.lit("other"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_op1_equals_brute_force(spark):
    r = random.Random(1)
    vectors = {i: [r.uniform(-1, 1) for _ in range(8)] for i in range(0, 400)}
    for i in range(0, 400, 3):
        vectors[i] = [0.5] * 8  # a third of the rows are one vector
    vectors |= {11: None, 12: [None] + [0.1] * 7, 13: [float("nan")] * 8, 14: [float("inf")] * 8, 15: [0.0] * 8}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").union(spark.createDataFrame([(None, [0.1] * 8)], "vec_id long, embedding array<double>")).withColumn("blob", F.lit(1))
    ints = {i: None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    want = brute.top(ints)
    for tree, fan, topmost in ((4096, 512, 4 << 20), (37, 512, 4 << 20), (37, 3, 1)):  # the last with levels above the subtrees
        got = mtree.top_products(mtree.quantised(df), F.col("vec_id") % 50 == 0, 5, tree=tree, block=3, page=8, fan=fan, topmost=topmost).collect()
        assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in got} == want


def test_op1_few_and_none(spark):
    one = spark.createDataFrame([(50, [0.5, 1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.search_embeddings(one).collect()] == [(50, 1, 1, 32768)]
    assert mtree.search_embeddings(one.where("false")).collect() == []
    big = spark.createDataFrame([(50, [1e7, 2e6]), (1, [1e7, -1e6]), (2, [-1e7, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in mtree.search_embeddings(big).collect()}
    assert got == {1: 2560000000 * 2560000000 - 512000000 * 256000000, 2: -2560000000 * 2560000000 + 512000000 * 256}


def test_op1_clusters_and_floors(spark, monkeypatch):
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 3000)] + 0.02 * r.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, v[100].tolist())], "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in row] for i, row in enumerate(v)}
    want = brute.top(ints)
    got = {}
    for x in mtree.top_products(mtree.quantised(df), F.col("vec_id") % 50 == 0, 5, tree=100, block=16, page=16).collect():
        got[x.query_id, x.rank] = (x.vec_id, x.score)
    twice = {q for q, _ in want if any(want[q, k][0] == 100 for k in range(1, 6))}  # row 100 stands twice
    assert {k: w for k, w in got.items() if k[0] not in twice} == {k: w for k, w in want.items() if k[0] not in twice}
    assert len(got) == len(want)


def test_op1_bounds_save_distances():
    r = np.random.default_rng(3)
    centres = r.integers(-250, 250, (20, 16))
    v = (centres[r.integers(0, 20, 4000)] + r.integers(-5, 6, (4000, 16))).astype(np.int64)
    t = mtree.MTree(np.arange(4000), v, 32)
    q = v[17]
    got = t.search(q, 17, 5)
    s = v @ q
    want = sorted(((-s[i], i) for i in range(4000) if i != 17))[:5]
    assert got == [(int(-a), int(b)) for a, b in want]
    assert t.seen < 2500


@pytest.mark.parametrize("n", [3000, 9000])
def test_op1_prunes_before_it_sends(spark, n):
    r = np.random.default_rng(5)
    share = {}
    for kind in ("clustered", "spread"):
        v = r.normal(size=(n, 16)) if kind == "spread" else r.normal(size=(8, 16))[r.integers(0, 8, n)] + 0.01 * r.normal(size=(n, 16))
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        base = mtree.quantised(df).withColumn("ask", F.col("vec_id") % 50 == 0).persist()
        reach = max(sum(x * x for x in row.v) for row in base.collect()) * (1 + 1e-12)
        some = base.orderBy(F.xxhash64("vec_id")).limit(256).collect()
        ids, pivots = np.array([row.vec_id for row in some]), np.array([row.v for row in some])
        order, _ = mtree.MTree._pages(pivots.astype(float), np.arange(len(pivots)), 1)
        ids, pivots = ids[order], pivots[order]
        trees = mtree._subtrees(mtree._routed(base, pivots, n // 50), 50, 16, 64, 5, reach, ids, pivots)
        pairs = sum(len(__import__("pickle").loads(row.ask)[1]) for row in mtree.asked_pairs(trees, reach, 16).collect())
        share[kind] = pairs / (n / 50) / trees.count()  # of all pairs of a query and a subtree
    print(n, share)
    assert share["clustered"] < 0.35 and share["clustered"] < share["spread"]


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 2), (4, 2)])
def test_hilbert_curve_is_continuous(spark, n, bits):
    cells = spark.range(1 << n * bits).select(*[F.pmod(F.floor(F.col("id") / (1 << bits * i)), F.lit(1 << bits)).alias(f"x{i}") for i in range(n)])
    got = cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(1 << n * bits))
    assert {sum(abs(a[i] - b[i]) for i in range(n)) for a, b in zip(got, got[1:])} == {1}


@pytest.mark.parametrize("clash", [False, True])
def test_op2_law_and_slots(spark, rows, clash):
    got = hilbert.shard(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    want = sorted((repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in order] == sorted(r.curve_index for r in got)  # shards are runs of the curve
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert hilbert.shard(empty(spark)).collect() == []


def test_op2_files_prune(spark, tmp_path):
    df = spark.range(4096).select(F.col("id").alias("doc_id"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    hilbert.write_shards(df, str(tmp_path / "h"), ("x", "y"), files=16)
    spans = spark.read.parquet(str(tmp_path / "h")).groupBy(F.input_file_name()).agg((F.max("x") - F.min("x")).alias("a"), (F.max("y") - F.min("y")).alias("b")).collect()
    assert len(spans) == 16 and max(max(r.a, r.b) for r in spans) < 48 and sum(r.a + r.b for r in spans) / 32 < 24


def test_op2_long_strings_and_negative_numbers_prune(spark, tmp_path):
    """Strings that share a long beginning are told apart; nulls and negatives too."""
    url = F.concat(F.lit("https://data.example.org/common-crawl/"), F.lpad((F.col("id") % 64).cast("string"), 3, "0"))
    df = spark.range(4096).select(F.col("id").alias("doc_id"), url.alias("source"), (F.floor(F.col("id") / 64) - 32).alias("depth"), F.when(F.col("id") % 7 > 0, F.date_sub(F.lit("1970-01-10").cast("date"), F.floor(F.col("id") / 64).cast("int"))).alias("day"))
    ranks = hilbert.rank_tables(df, ["source"])["source"].collect()
    assert [r._value for r in sorted(ranks, key=lambda r: r._slot)] == sorted(r._value for r in ranks) and [r._slot for r in sorted(ranks, key=lambda r: r._slot)] == list(range(64))
    hilbert.write_shards(df, str(tmp_path / "h"), ("source", "depth"), files=16)
    spans = spark.read.parquet(str(tmp_path / "h")).groupBy(F.input_file_name()).agg(F.countDistinct("source").alias("a"), (F.max("depth") - F.min("depth")).alias("b")).collect()
    assert len(spans) == 16 and max(max(r.a, r.b) for r in spans) < 48 and sum(r.a + r.b for r in spans) / 32 < 24
    text = df.withColumn("text", F.lit("x"))
    got = hilbert.shard(text, dims=("source", "depth", "day")).collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    where = {r.doc_id: r for r in text.collect()}
    # each shard's own rows cover a part of each dimension only
    for lo in range(0, 4096, 512):
        part = [where[d] for d in order[lo : lo + 512]]
        assert len({r.source for r in part}) < 64 or len({r.depth for r in part}) < 64
    cells = df.select(hilbert.quantise(F.col("depth").cast("double"), [-5.0, 0.0]).alias("q"), "depth").distinct().collect()
    assert all(r.q == (r.depth > -5) + (r.depth > 0) for r in cells)
    assert spark.range(1).select(hilbert.quantise(F.lit(None).cast("double"), [-5.0, 0.0]).alias("q")).first().q == 0


@pytest.mark.parametrize("clash", [False, True])
def test_op3_equals_brute_force(spark, rows, clash):
    got = pairs(grace.exact_dedup(frame(spark, rows, clash)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    b = brute.exact(rows)
    want = sorted([(d, b[i][0], b[i][1], d == b[i][0], b[i][2]) for i, (d, _) in enumerate(rows)], key=repr)
    assert got == want
    assert grace.exact_dedup(empty(spark)).collect() == []


def test_op3_spills_and_recursion():
    r = random.Random(5)
    made = []
    for i in range(600):
        content = bytes(r.choices(b"ab", k=r.choice([4, 6, 200])))
        made.append((__import__("hashlib").sha256(content).digest(), content, len(content), i, 1, {"i": i}))
    got = sorted((g[grace.CONTENT], g[grace.ID], g[grace.COUNT]) for g in grace.grace(iter(made), 3000))
    want = {}
    for m in made:
        want.setdefault(m[1], []).append(m[3])
    assert got == sorted((c, min(i), len(i)) for c, i in want.items())
    same = [(b"\0" * 32, str(i % 50).encode() * 40, 1, i, 1, None) for i in range(200)]  # digests that collide
    assert len(list(grace.grace(iter(same), 100))) == 50


def test_op3_wide_payload_and_spill_budget():
    """The table counts what rides along: wide rows spill although their contents are short."""
    wide = [(__import__("hashlib").sha256(b"%d" % i).digest(), b"%d" % i, 1, i, 1, {"a": "x" * 5000, "n": i, "l": [1, 2]}) for i in range(50)]
    table = grace.OpenTable()
    for w in wide:
        table.add(w)
    assert table.bytes > 50 * 5000
    table.add((*wide[0][:2], 2, 99, 1, {"a": "y" * 50_000, "n": 0, "l": None}))  # replaces the first row
    assert table.bytes > 50 * 5000 + 40_000
    assert sorted(g[grace.ID] for g in grace.grace(iter(wide), 20_000)) == list(range(50))


@pytest.mark.parametrize("budget", [48 << 20, 20_000])
def test_op3_keep_distinct_wide_rows(spark, rows, budget):
    df = frame(spark, rows, True).withColumn("wide", F.repeat(F.lit("z"), 500)).withColumn("nested", F.array(F.struct(F.lit(1).alias("a"))))
    plain, back = grace.numbered_columns(df)
    got = grace.distinct_texts(plain, None, "c1", "c0", budget=budget).select(*back)
    assert got.columns == df.columns
    b = brute.exact(rows)
    want = {(b[i][0], b[i][2]) for i in range(len(rows))}
    have = [(r.doc_id, __import__("hashlib").sha256("".join(brute.WORD.findall(r.text or "")).encode()).hexdigest(), len(r.wide), r.nested[0].a) for r in got.collect()]
    assert sorted(have, key=repr) == sorted([(*w, 500, 1) for w in want], key=repr)


def test_op5_long_pieces_are_not_remembered():
    c = bpe.Codec(*bpe.default_vocabulary())
    r = random.Random(3)
    long = ["".join(r.choice("abcdefgh") for _ in range(20_000)) for _ in range(3)]
    out = c.encode_texts([" ".join(long), "short words here", long[0]])
    assert c.decode_ids(out[0]).decode() == " ".join(long) and c.decode_ids(out[2]).decode() == long[0]
    assert max(map(len, c.known)) <= bpe.LONGEST and c.held < 10_000


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_op4_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = pairs(debruijn.substring_dedup(frame(spark, rows, seed == 8)), "doc_id", "n_words", "n_removed", "kept_sha256")
    b = brute.windows(rows)
    assert got == sorted([(d, *b[i]) for i, (d, _) in enumerate(rows)], key=repr)
    assert any(r[2] for r in got)


def test_op4_branching_and_periodic(spark):
    r = random.Random(2)
    base = [str(r.randrange(6)) for _ in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(80)] = "edit" + str(r.randrange(3))
        a = r.randrange(60)
        rows.append((i * 3 % 41, " ".join(w[a:] + ["a", "b"] * r.randrange(20))))
    got = pairs(debruijn.substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    b = brute.windows(rows)
    assert got == sorted([(d, *b[i]) for i, (d, _) in enumerate(rows)], key=repr)
    assert debruijn.substring_dedup(empty(spark)).collect() == []


@pytest.fixture(scope="module")
def encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op5_equals_library(spark, rows, encoding):
    r = random.Random(4)
    odd = ["".join(r.choice("abtheé日🙂 \n\t'012!<|") for _ in range(n)) for n in (1, 63, 64, 65, 66, 700, 5000)] + ["<|endoftext|>", "aaaaaaaa" * 50, "é" * 90, " " * 300]
    rows = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    got = bpe.tokenize(frame(spark, rows, True), keep_ids=True).collect()
    sha = lambda b: __import__("hashlib").sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    assert sorted([tuple(x) for x in got], key=repr) == sorted(want, key=repr)
    assert bpe.tokenize(empty(spark)).collect() == []


def test_op6_permutation_is_a_bijection():
    p = feistel.Permutation(b"k")
    for size in (1, 2, 10, 97, 1000):
        out = [p.forward(x, size, b"t") for x in range(size)]
        assert sorted(out) == list(range(size)) and [p.backward(y, size, b"t") for y in out] == list(range(size))
    assert [p.forward(x, 1000, b"a") for x in range(9)] != [p.forward(x, 1000, b"b") for x in range(9)]


def test_op6_formats_and_links():
    tool = feistel.Pseudonyms(b"key")
    text = "Mail bob.7@mail3.example.com, call +1 (555) 555-1234, card 4111 1111 1111 1111, born 2001-02-28, 28.02.2001, from 10.20.30.40, id 123-45-6789, token = \"0123456789abcdef0123\""
    new, kinds = tool.encode(text)
    assert sorted(kinds) == sorted(["email", "phone", "card", "date", "date", "ip", "ssn", "secret"])
    assert len(new) >= len(text) - 8 and not any(x in new for x in ("bob.7", "555-1234", "4111 1111", "2001-02-28", "10.20.30.40", "123-45-6789", "0123456789abcdef"))
    assert tool.decode(new) == text
    card = "".join(c for c in new[new.index("card ") + 5 :].split(",")[0] if c.isdigit())
    assert len(card) == 16 and feistel.luhn_digit(card[:-1]) == card[-1]
    assert tool.encode("x 10.20.30.40 y")[0].split()[1] in new  # the same value, the same pseudonym
    day = new[new.index("born ") + 5 :][:10]
    datetime.date.fromisoformat(day)
    assert feistel.Pseudonyms(b"other").encode(text)[0] != new


def test_op6_accounts_and_plain_phones():
    tool = feistel.Pseudonyms(b"key")
    text = "GB82 WEST 1234 5698 7654 32 or DE89370400440532013000, call 555-867-5309 or 555.867.5309."
    new, kinds = tool.encode(text)
    assert kinds == ["iban", "iban", "phone", "phone"] and tool.decode(new) == text
    assert not any(x in new for x in ("WEST", "0532013000", "867"))
    assert tool.encode("GB83 WEST 1234 5698 7654 32 and 555-867.5309")[1] == []


def test_op6_more_formats():
    tool = feistel.Pseudonyms(b"key")
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    long = "".join("abcdefghijklmnopqrstuvwxyz0123456789"[i * 7 % 36] for i in range(700))
    cases = {f"token={jwt}": "secret", f"api_key: {long}": "secret", "at 2020-01-02T10:00:00Z": "date", "born 02/28/2001": "date", "born 12/31/1999.": "date", "on 4 July 1985": "named", "on July 14, 1985": "named", "call +14155550123 now": "phone", "call 415 555 0123 now": "phone", "card 4111 1111 1111 1111 123 end": "card", "card 4111 1111 1111 1111 12": "card"}
    for text, kind in cases.items():
        new, kinds = tool.encode(text)
        assert kinds == [kind] and new != text and tool.decode(new) == text, (text, new)
    new = tool.encode(f"token={jwt}")[0]
    assert new.count(".") == 2 and not any(part in new for part in jwt.split("."))
    assert tool.encode("card 4111 1111 1111 1111 123 end")[0].endswith(" 123 end")
    new = tool.encode("born 02/28/2001")[0][5:]
    assert datetime.datetime.strptime(new, "%m/%d/%Y").day > 12
    assert tool.encode("31 February 2001 and 02/30/2001") == ("31 February 2001 and 02/30/2001", [])


def test_op6_all_days_are_permuted():
    """Brute force over every day of a format: no two days share a pseudonym, all come back."""
    tool = feistel.Pseudonyms(b"key")
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(731)]
    for form, some in (("%Y-%m-%d", days), ("%d.%m.%Y", days), ("%m/%d/%Y", [d for d in days if d.day > 12])):
        new = [tool.encode(d.strftime(form))[0] for d in some]
        assert len(set(new)) == len(some) and [tool.decode(x) for x in new] == [d.strftime(form) for d in some]
    assert tool.encode("2001-02-03")[0].split("-") == tool.encode("03.02.2001")[0].split(".")[::-1]  # one value, one pseudonym


def test_op6_query_equals_plain_reading(spark, rows):
    """The rows against a plain loop over every match of the pattern in every text."""
    more = rows + [(900 + i, t) for i, t in enumerate(["ip 10.0.0.1 and 300.1.1.1", "mail a.b@c.example.org, 4111 1111 1111 1111", "2001-02-03 or 2001-02-31", "555-867-5309"])]
    tool, want = feistel.Pseudonyms(feistel.DEMO_KEY), []
    for d, t in more:
        out, at, n = "", 0, 0
        for m in tool.pattern.finditer(t or ""):
            new = getattr(tool, f"_{m.lastgroup}")(m[0], False)
            out += t[at : m.start()] + (m[0] if new is None else new)
            at, n = m.end(), n + (new is not None)
        want.append((d, n, out + (t or "")[at:]))
    assert pairs(feistel.pseudonymise(frame(spark, more)), "doc_id", "n_found", "text") == sorted(want, key=repr)


def test_op6_leaves_the_rest():
    tool = feistel.Pseudonyms(b"key")
    for t in ("4111 1111 1111 1112 and 0000000000000000", "version 3.1.4.1591", "2024-02-31", "300.1.1.1", "a@b", "CC BY-NC 4.0", "token of thanks", "12345678901234567890123"):
        assert tool.encode(t) == (t, [])


def test_op6_query_rows(spark, rows):
    got = feistel.pseudonymise(frame(spark, rows + [(900, "ip 10.0.0.1")], True)).collect()
    assert len(got) == len(rows) + 1
    assert [(r.n_found, r.kinds) for r in got if r.doc_id == 900] == [(1, "ip")]
    same = {repr(r.doc_id) + r.text for r in got if r.n_found == 0}
    assert {repr(d) + (t or "") for d, t in rows} == same
    assert feistel.pseudonymise(empty(spark)).collect() == []


def test_op7_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    got = lsa.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted for r in got if r.quality == 1]
    bad = [r.predicted for r in got if r.quality == 0]
    assert len(got) > 500 and np.mean(good) > 0.97 and np.mean(bad) < 0.2
    pos, neg = np.array([r.score for r in got if r.quality == 1]), np.array([r.score for r in got if r.quality == 0])
    assert (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean() > 0.97


def test_op7_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = load(spark, DATA, "documents"), load(spark, DATA, "labels")
    flipped = labels.withColumn("quality", F.when(lsa.in_training(), F.col("quality")).otherwise(1 - F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "score": F.lit(3)})
    a, b = (pairs(lsa.quality(x, y), "doc_id", "score") for x, y in ((docs, labels), (other, flipped)))
    assert a == b


def test_op7_votes_equal_plain_neighbours(spark, rows):
    """Every score against a plain vote: one document at a time, all cosines sorted."""
    labels = spark.createDataFrame([(d, d % 2, 0) for d in sorted({d for d, _ in rows if d is not None})], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = lsa.fit_quality(docs, labels)
    got = {(r.doc_id, r.text): r.score for r in lsa.score_quality(docs.select("doc_id", "text"), model).collect()}

    def latent(t):
        z = lsa.features(t.encode()).astype(np.float64) @ model.basis.astype(np.float64)
        return z / max(np.linalg.norm(z), 1e-9)

    for (_, t), score in got.items():
        cosine = sorted(((float(v.astype(np.float64) @ latent(t or "")), float(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)
        # rows of equal cosine may be taken in any order: the vote lies between the extremes
        edge = cosine[lsa.NEIGHBOURS - 1][0]
        sure = [c for c in cosine if c[0] > edge + 1e-5]
        ties = sorted((y, c) for c, y in cosine if abs(c - edge) <= 1e-5)
        bounds = []
        for part in (ties[: lsa.NEIGHBOURS - len(sure)], ties[len(ties) - (lsa.NEIGHBOURS - len(sure)) :]):
            votes = [(max(c, 1e-6) ** 4, y) for c, y in sure] + [(max(c, 1e-6) ** 4, y) for y, c in part]
            bounds.append(sum(w * y for w, y in votes) / sum(w for w, _ in votes))
        assert bounds[0] - 1e-3 <= score <= bounds[1] + 1e-3


def test_op7_edges(spark, rows):
    labels = spark.createDataFrame([(d, (d or 0) % 2, 0) for d, _ in rows if d is not None] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = lsa.quality(frame(spark, rows, True), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id == 3} == {zlib.crc32(b"3") % 5 == 0}
    none = lsa.quality(frame(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert lsa.quality(empty(spark), labels).collect() == []


def test_op8_equals_brute_force(spark, rows):
    got = templates.line_dedup(frame(spark, rows, True)).collect()
    want = brute.lines(rows)
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted([(d, w) for (d, _), w in zip(rows, want)], key=repr)
    assert any(r.n_dropped for r in got)
    assert templates.line_dedup(empty(spark)).collect() == []


def test_op8_generalises_fields(spark):
    rows = [(i, f"Served in {i * 7} ms by node-{i} at 10.0.0.{i}\nown line {'abc'[i % 3]} of doc\nunique words {'x' * (i + 1)}") for i in range(6)]
    # unique halves stay: more than one run of the line differs
    rows += [(10 + i, "the first eight words of this long line stay but " + end) for i, end in enumerate(["one two three four", "five six seven eight", "nine ten eleven twelve"])]
    # one variable field at the leaf goes with its template
    rows += [(20 + i, f"the user {name} asked for the list of all open tickets in the north") for i, name in enumerate(["anna", "bert", "carla"])]
    rows += [(30 + i, f"the user asked for the list of all {name} open tickets in the north") for i, name in enumerate(["red", "blue", "green"])]
    got = {r.doc_id: r.text.split("\n") for r in templates.line_dedup(frame(spark, rows)).collect()}
    assert got[0][0].startswith("Served") and all(not x[0].startswith("Served") for d, x in got.items() if 0 < d < 6)
    assert all(f"unique words {'x' * (i + 1)}" in got[i] for i in range(6))
    assert all(got[10 + i] != [""] for i in range(3))
    assert all(got[20 + i] != [""] for i in range(3))  # the leading tokens differ: other branches of the tree
    assert [got[30 + i] != [""] for i in range(3)] == [True, False, False]
    want = {d: t for (d, _), t in zip(rows, brute.lines(rows))}
    assert {d: "\n".join(t) for d, t in got.items()} == want


def hot_corpus(n):
    """A line and a passage that stand in every document, and windows that differ at a piece
    that every document holds."""
    passage = " ".join(f"p{i}" for i in range(30))
    return [(i, f"{passage}\nthe one line of all\nown{i} a{i} b{i} all of us agree on c{i} d{i} e{i} f{i} g{i} h{i} i{i}") for i in range(n)]


@pytest.mark.parametrize("n", [300, 1200])
def test_op4_op8_hot_keys_are_bounded_by_packs(spark, n, monkeypatch):
    monkeypatch.setattr(recurring, "PACK_BYTES", 64 << 10)
    monkeypatch.setattr(recurring, "HOT", 100)
    df = frame(spark, hot_corpus(n))
    packs, buckets = recurring.packed(df)
    n_packs = packs.select("_pack").distinct().count()
    for keys_of in (debruijn.anchor_keys, templates.held_keys):
        got = recurring.recurring(packs, buckets, keys_of, n, ids=True).collect()
        entries = [len(r["keys"]) // 8 for r in got]
        # what all documents hold comes back once for each pack
        held = len(np.unique(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in got])))
        assert held and sum(entries) <= held * n_packs and n_packs < n / 5
    rows = hot_corpus(n)
    assert sorted(r.text for r in templates.line_dedup(df).collect()) == sorted(brute.lines(rows))
    b = brute.windows(rows)
    assert pairs(debruijn.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted([(d, *b[i]) for i, (d, _) in enumerate(rows)], key=repr)


def test_op4_op8_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(recurring, "PACK_BYTES", 4 << 10)
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text)] * 400, "doc_id long, text string")
    sizes = [r["count"] for r in recurring.packed(df)[0].groupBy("_pack").count().collect()]
    assert max(sizes) <= 4096 // len(text) + 1
    assert {r.n_removed for r in debruijn.substring_dedup(df).collect()} == {0}
    for f in (debruijn.substring_dedup, templates.line_dedup):
        with pytest.raises(TypeError):
            f(df.withColumn("doc_id", F.lit("a")))


@pytest.mark.parametrize("hot", [2048, 2])
def test_op9_equals_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot)
    monkeypatch.setattr(simhash.link_forest, "__defaults__", (simhash.DISTANCE, hot))
    more = rows + [(500 + i, "w1 w2 w3 w4 w5 " * 30 + f"tail{i % 4}") for i in range(20)]
    got = pairs(simhash.near_duplicates(frame(spark, more, True)).select("doc_id", simhash.hex16().alias("f"), "component_id"), "doc_id", "f", "component_id")
    want = sorted([(d, f"{fp:016x}", c) for (d, _), (fp, c) in zip(more, brute.near(more))], key=repr)
    assert got == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_op9_index_and_groups_find_all_links(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in r.integers(0, 63, (30, 2))]
    fp = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    gap = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(gap <= 2, 1)))}
    index = simhash.GrayIndex(fp)
    place = {int(x): i for i, x in enumerate(fp)}
    got = {tuple(sorted((place[int(index.leaf[a])], place[int(index.leaf[b])]))) for x, y in index.links(2) for a, b in zip(x, y)}
    assert got == want
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for hot in (10_000, 3):
        root = {r.node: r.root for r in components(simhash.link_forest(df, 2, hot)).collect()}
        for i, j in want:
            assert root[int(fp.view(np.int64)[i])] == root[int(fp.view(np.int64)[j])]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in list(root)}


def test_op10_targets_and_nonnegative(spark):
    docs, labels = load(spark, DATA, "documents"), load(spark, DATA, "labels")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == docs.count()
    total = sum(r.tokens for r in got)
    for d, w in mixing.WEIGHTS.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) - w * total) < 1e-4 * total
    assert min(r.rate for r in got) >= 0 and abs(sum(r.p_clean + r.p_low + r.p_toxic for r in got) - len(got)) < 0.01


def test_op10_least_squares_equals_plain(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.3, 0.3], 80).round(6)
    t = r.integers(1, 500, 80)
    table = spark.createDataFrame([(i, int(t[i]), *map(float, p[i])) for i in range(80)], "doc_id long, tokens long, p_clean double, p_low double, p_toxic double")
    goal = {"clean": 2.0 * t.sum(), "low": 0.1 * t.sum(), "toxic": 0.0}
    found = mixing.rates(table, goal, passes=60)
    seen = found.errors
    got = np.array([x[0] for x in found.on(table).orderBy("doc_id").select("_r").collect()])
    g = np.array(list(goal.values()))
    total = t.sum()
    a, g = (p * t[:, None]).T / total, g / total
    value = lambda x: 0.5 * np.sum((a @ x - g) ** 2) + 0.5 * mixing.RIDGE * np.sum(t / total * (x - 1) ** 2)
    x = np.ones(80)
    for _ in range(200_000):  # plain projected gradient, scaled by the tokens
        x = np.maximum(0, x - 0.5 * (p @ (a @ x - g) + mixing.RIDGE * (x - 1)))
    assert (got >= 0).all() and value(got) < value(x) + 1e-7
    assert seen[-1] < 1e-6 < seen[0]


def test_op10_infeasible_targets_show(spark, caplog):
    """Nobody belongs to the third domain: its target is missed, and that is told."""
    table = spark.createDataFrame([(i, 10, 0.7, 0.3, 0.0) for i in range(50)], "doc_id long, tokens long, p_clean double, p_low double, p_toxic double")
    found = mixing.rates(table, {"clean": 350.0, "low": 150.0, "toxic": 500.0})
    assert abs(found.missed["toxic"] - 0.5) < 1e-6 and found.missed["clean"] < 1e-3 and "missed" in caplog.text
    r = [x._r for x in found.on(table).collect()]
    assert min(r) >= 0 and max(r) - min(r) < 1e-9
    far = mixing.rates(table, {"clean": -100.0, "low": 0.0, "toxic": 0.0})
    assert {x._r for x in far.on(table).collect()} == {0.0}


def test_op10_classifier_equals_plain_gradient(spark):
    """The softmax fit against plain gradient descent on the same loss."""
    r = np.random.default_rng(8)
    y = r.integers(0, 3, 120)
    x = np.abs(r.normal(size=(120, mixing.BUCKETS + mixing.STYLES)) * (r.random((120, mixing.BUCKETS + mixing.STYLES)) < 0.01)).astype(np.float32)
    x[np.arange(120), y] += 1
    x[:, mixing.BUCKETS] = 1
    weight = np.ones(120)
    got = mixing.Softmax(x, y, weight, 3, steps=300, decay=1e-2).posteriors(x)
    idf = np.ones(x.shape[1])
    idf[: mixing.BUCKETS] = np.log((1 + len(x)) / (1 + (x[:, : mixing.BUCKETS] > 0).sum(0)))
    z, w = x * idf, np.zeros((x.shape[1], 3))
    for _ in range(4000):
        q = np.exp(z @ w - (z @ w).max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        w -= 0.05 * (z.T @ ((q - np.eye(3)[y]) / 120) + 1e-2 * w)
    q = np.exp(z @ w - (z @ w).max(1, keepdims=True))
    assert np.abs(got - q / q.sum(1, keepdims=True)).max() < 0.02


def test_op10_resample_rows_have_their_own_rates(spark):
    docs = spark.createDataFrame([(None, f"word{i} " * (i + 1)) for i in range(40)] + [(7, "one text"), (7, "another text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.resample(docs, labels)
    assert got.columns == docs.columns
    have = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in got.collect()} <= have and got.count() > 0
    assert mixing.resample(docs.where("false"), labels).collect() == []


def test_op10_edges(spark, rows):
    labels = spark.createDataFrame([(d, (d or 0) % 2, (d or 0) % 5 == 0) for d, _ in rows], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got = mixing.mix(frame(spark, rows, True), labels).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got) and {r.tokens for r in got if r.doc_id in (150, 151, 152)} == {0}
    assert len(mixing.mix(frame(spark, rows), labels.where("false")).collect()) == len(rows)
    assert mixing.mix(empty(spark), labels).collect() == []


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
