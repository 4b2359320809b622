"""Deduplication by key, preference and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: str, by: list[Column], keep: str = "kept", salt: int = 0) -> DataFrame:
    """Marks the first row of each key in the order `by` (a total order). With salt > 0
    the rows of a key are first ranked in that many parts, and only the winners meet, so
    a key that holds a third of all rows isn't sorted in one task."""
    if not salt:
        return df.withColumn(keep, F.row_number().over(Window.partitionBy(key).orderBy(*by)) == 1)
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salt))
    first = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by)))
    winners = first.where("_rank = 1").withColumn("_best", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_best = 1").select(F.col(key).alias("_key"), F.col("_part").alias("_of"))
    out = first.join(winners, first[key].eqNullSafe(winners["_key"]), "left")
    return out.withColumn(keep, (F.col("_rank") == 1) & (F.col("_part") == F.col("_of"))).select(*df.columns, keep)


def merge_sources(df: DataFrame, url: str, id_: str, ord_: str) -> DataFrame:
    """Sources with the same URL: the smallest id is primary, others are aliases."""
    g = df.groupBy(url).agg(F.min(id_).alias("primary_id"), F.array_sort(F.collect_set(id_)).alias("ids"), F.min(ord_).alias("first_ord"))
    return g.withColumn("n_aliases", F.size("ids") - 1)


def remap(arrays: DataFrame, column: str, key: str, aliases: DataFrame) -> DataFrame:
    """Replaces ids in an array by their primary ids, keeping the order and the first of
    those that become equal. aliases: alias, primary_id."""
    flat = arrays.select(key, F.posexplode(column).alias("pos", "alias")).join(aliases, "alias", "left").select(key, "pos", F.coalesce("primary_id", "alias").alias("id"))
    return flat.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])).alias(column))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_by_ord(df: DataFrame, key: str, ord_: str) -> DataFrame:
    """The first row of each key, in the order of ord_ (an aggregate, not a sort)."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(ord_)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_frontier(df: DataFrame, url: str, title: str, parent: str, ord_: str) -> DataFrame:
    """URLs to visit: the first title that isn't blank, and all parents."""
    named = F.min(F.when(F.coalesce(F.col(title), F.lit("")) != "", F.struct(ord_, title)))
    return df.groupBy(url).agg(F.coalesce(named[title], F.lit("")).alias(title), F.array_sort(F.collect_set(parent)).alias("parents"))


def pending(frontier: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """What the ledger doesn't hold yet."""
    return frontier.join(ledger.select(key).distinct(), key, "left_anti")


def by_signature(rows: DataFrame, signature: list[str], keep: str) -> DataFrame:
    """One row for each signature, null-safe: the signature and the least value of `keep`."""
    g = rows.groupBy(F.struct(*signature).alias("_s")).agg(F.min(keep).alias(keep))
    return g.select("_s.*", keep)


def cached(asked: DataFrame, entries: DataFrame, key: str, now: Column, valid: Column | None = None) -> DataFrame:
    """asked with the entry of its key and whether it is a hit: it is there, hasn't expired
    (column expires_at) and `valid`, tested on what was read, holds. Anything else, a null
    included, is a miss: the answer is made anew, no error. Of several entries of a key the
    one that lasts longest counts."""
    last = entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), "expires_at").alias("entry"))
    good = F.col("entry.expires_at") > now
    return asked.join(last, key, "left").withColumn("hit", F.coalesce(good if valid is None else good & valid, F.lit(False)))
