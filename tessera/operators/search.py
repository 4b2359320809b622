"""Finding which texts contain which passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passages up to so many rows and characters are broadcast and tested one by one.
FEW, SMALL = 2_000, 4 << 20
#: Words of the key by which more passages meet the texts.
ANCHOR = 4


def _anchors(needle: Column, body: Column, kind: int) -> tuple[Column, Column]:
    """The hash that a passage of a kind is looked up by, and all such of a text."""
    if kind > 100:
        q = kind - 100
        signs = F.split(body, "")  # once, as to find the n-th sign of a string takes n steps
        places = F.sequence(F.lit(1), F.greatest(F.size(signs) - q + 1, F.lit(1)))
        return F.xxhash64(F.substring(needle, 1, q)), F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(signs, i, F.lit(q)), "")))
    words = F.split(body, " ")
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - kind + 1, F.lit(1)))
    return F.xxhash64(F.array_join(F.slice(F.split(needle, " "), 2, kind), " ")), F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(kind)), " ")))


def contains_join(texts: DataFrame, passages: DataFrame, key: str, body: str, needle: str, few: int = FEW, small: int = SMALL) -> DataFrame:
    """Pairs of a text (key, body) and a passage that stands in it verbatim. The passages
    are counted first. A few small ones are broadcast. Otherwise a passage is looked up by
    what must stand in the text as it is: one of three words or more by up to ANCHOR of the
    words inside it, which are whole words wherever it stands; a shorter one by its first
    characters, 16 or as many as it has (a power of two). Every pair that meets is checked;
    an empty passage stands in every text."""
    size = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length(needle)), F.lit(0)).alias("chars")).first()
    hit = F.col(body).contains(F.col(needle))
    if size.n <= few and size.chars <= small:
        return texts.join(F.broadcast(passages), hit)
    n, length = F.size(F.split(F.col(needle), " ")), F.char_length(needle)
    kind = F.when(n >= 3, F.least(n - 2, F.lit(ANCHOR)))
    for q in (16, 8, 4, 2, 1):
        kind = kind.when(length >= q, F.lit(100 + q))
    p = passages.withColumn("_kind", kind.otherwise(0))
    found = None
    for which in sorted(r[0] for r in p.select("_kind").distinct().collect()):  # at most ten kinds
        part = p.where(F.col("_kind") == which).drop("_kind")
        if which == 0:
            pairs = texts.join(part, hit)
        else:
            anchor, grams = _anchors(F.col(needle), F.col(body), which)
            anchored = part.withColumn("_a", anchor)
            met = texts.select(key, F.explode(F.array_distinct(grams)).alias("_a")).join(anchored.select("_a").distinct(), "_a", "left_semi")
            pairs = texts.join(met.join(anchored, "_a").drop("_a").distinct(), key).where(hit)
        found = pairs if found is None else found.unionByName(pairs)
    return found
