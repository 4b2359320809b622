"""Sharding along a Hilbert curve, in DataFrame functions only.

Each metadata dimension is cut into 2**BITS ranges at approximate quantiles, the cell
gets its place on the curve, and the rows are range-partitioned and numbered by (place
on the curve, checksum, id). A shard is a run of that order, so its files cover a small
box of every dimension and a reader skips them by their minima and maxima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, settle

BITS, SHARDS = 5, 8


def rank_tables(df: DataFrame, dims: list[str]) -> dict[str, DataFrame]:
    """For each string dimension its distinct values (whole, not a prefix) with their ranks."""
    texts = [d for d in dims if df.schema[d].dataType.typeName() == "string"]
    return {d: numbered(df.where(F.col(d).isNotNull()).select(F.col(d).alias("_value")).distinct(), ["_value"]) for d in texts}


def with_ordinals(df: DataFrame, dims: list[str], ranks: dict[str, DataFrame]) -> DataFrame:
    """df with `_o_<dim>` for each dimension: a number that keeps its order, null for null.
    Numbers, dates and times stand for themselves, a string for the rank of its value."""
    for d in dims:
        if d in ranks:
            of = ranks[d].select(F.col("_value").alias(f"_v_{d}"), F.col("_slot").cast("double").alias(f"_o_{d}"))
            df = df.join(of, F.col(d) == F.col(f"_v_{d}"), "left").drop(f"_v_{d}")
        elif df.schema[d].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
            df = df.withColumn(f"_o_{d}", F.unix_micros(F.col(d).cast("timestamp")).cast("double"))
        else:
            df = df.withColumn(f"_o_{d}", F.col(d).cast("double"))
    return df


def cut_points(df: DataFrame, dims: dict[str, "F.Column"], bits: int = BITS) -> dict[str, list[float]]:
    """Upper ends of the ranges of each dimension: at most 2**bits - 1 numbers each,
    from one aggregation over all rows."""
    n = 1 << bits
    at = [i / n for i in range(1, n)]
    row = df.agg(*[F.percentile_approx(c, at, 2000).alias(k) for k, c in dims.items()]).first()
    return {k: sorted(set(row[k] or [])) for k in dims}


def quantise(value: "F.Column", cuts: list[float]) -> "F.Column":
    """Number of cuts below the value: a binary search written as one expression. Null falls
    into the first cell."""
    def between(lo: int, hi: int) -> "F.Column":
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]), between(mid + 1, hi)).otherwise(between(lo, mid))

    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(between(0, len(cuts)))


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, cell) of the n-dimensional Hilbert curve.
    A state is (entry corner, direction); the rule is Hamilton's: rotate and reflect
    the cell into the state, read its place in the Gray code, move on."""
    full = (1 << n) - 1
    digits, following = [], []

    def rot(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & full

    def gray(x: int) -> int:
        return x ^ x >> 1

    for state in range((1 << n) * n):
        entry, turn = divmod(state, n)
        for cell in range(1 << n):
            code = rot(cell ^ entry, n - (turn + 1) % n)
            w = next(x for x in range(1 << n) if gray(x) == code)
            start = gray(2 * ((w - 1) // 2)) if w else 0
            odd = w if w & 1 else w - 1
            inner = 0 if w == 0 else ((~odd & (odd + 1)).bit_length() - 1) % n
            digits.append(w)
            following.append((entry ^ rot(start, turn + 1)) * n + (turn + inner + 1) % n)
    return digits, following


def hilbert_index(axes: list["F.Column"], bits: int = BITS) -> "F.Column":
    """Place on the Hilbert curve of the cell with these coordinates (longs)."""
    n = len(axes)
    digits, following = (F.array(*[F.lit(x).cast("long") for x in t]) for t in curve_tables(n))

    def step(acc: "F.Column", q: "F.Column") -> "F.Column":
        cell = reduce(lambda a, b: a + b, [F.when(x.bitwiseAND(q) != 0, 1 << i).otherwise(0) for i, x in enumerate(axes)])
        at = (acc.getField("s") * (1 << n) + cell).cast("int")
        return F.struct((acc.getField("h") * (1 << n) + F.get(digits, at)).alias("h"), F.get(following, at).alias("s"))

    zero = F.lit(0).cast("long")
    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, F.struct(zero.alias("h"), zero.alias("s")), step).getField("h")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df, range-partitioned by `order` and written to the shared folder, with `_slot`, the
    gapless place of each row from 0. Sizes of partitions are summed up and joined back: one
    row each, however many rows they hold."""
    n = max(1, parts(df.sparkSession))
    dealt = settle(settle(df).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_slot", F.row_number().over(w) - 1).join(before, "_part").withColumn("_slot", F.col("_slot") + F.col("_before")).drop("_part", "_before")


def on_curve(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "curve_index") -> DataFrame:
    """df with each row's place on the curve over these dimensions."""
    ranks = rank_tables(df, dims)
    places = {d: F.col(f"_o_{d}") for d in dims}
    cuts = cut_points(with_ordinals(df.select(*dims), dims, ranks), places, bits)
    return with_ordinals(df, dims, ranks).withColumn(name, hilbert_index([quantise(places[d], cuts[d]) for d in dims], bits)).drop(*[f"_o_{d}" for d in dims])


def shard(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard,
    curve_index. Law `rows`: counts of any two shards differ by one at most. A shard is a
    run of the Hilbert order over dims; within a cell equal texts are neighbours (by
    size and checksum), then doc_id decides. Null texts have size 1 and checksum 0; null
    metadata share the first cell of their dimension with its least values; repeated rows get
    slots of their own (which of them is first doesn't show); an empty table gives no rows."""
    text, names = F.coalesce(F.col("text"), F.lit("")), [f"_d{i}" for i in range(len(dims))]
    # the texts are read once: all that follows is of narrow rows
    narrow = settle(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(d).alias(n) for d, n in zip(dims, names, strict=True)]))
    placed = numbered(on_curve(narrow, names, bits).drop(*names), ["curve_index", "size", "text_crc32", "doc_id"])
    total = max(narrow.count(), 1)
    s = F.expr(f"cast(_slot * {shards}L div {total}L as int)")
    return placed.withColumn("shard", s).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr(f"_slot - (cast(shard as long) * {total}L + {shards - 1}L) div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS, files: int | None = None) -> None:
    """Writes whole rows in curve order as Parquet files with narrow minima and maxima
    in every dimension, so that readers skip files by any of them."""
    n = files or parts(docs.sparkSession)
    names = [f"_d{i}" for i in range(len(dims))]
    copied = docs.select("*", *[F.col(d).alias(x) for d, x in zip(dims, names, strict=True)])
    curved = on_curve(copied, names, bits, "_curve").drop(*names)
    curved.repartitionByRange(n, "_curve", "doc_id").sortWithinPartitions("_curve", "doc_id").drop("_curve").write.parquet(path)
