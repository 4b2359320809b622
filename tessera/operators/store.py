"""What a session store answers and changes: histories, citations, visibility, owned
inserts, upserts, status counts and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_history(messages: DataFrame, item: Column) -> DataFrame:
    """Turns of each session and `item` of its messages in order of turn. A session without
    messages has no row; messages of one turn are ordered by their item."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("_i")))), lambda x: x["_i"])
    return messages.groupBy("session_id").agg(F.count("*").alias("turns"), items.alias("history"))


def citations(messages: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Cited sources of each message, in order of their id; a message that cites none has no
    row. key: a column of both."""
    g = messages.select("message_id", key).join(sources.select("source_id", key), key).groupBy("message_id")
    return g.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source_id")).alias("sources"))


def visible(users: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """How many sources share `key` (the school) with a user. Sources are counted by key
    before the join, so a large school sends one row."""
    per = sources.groupBy(key).agg(F.count("*").alias("_n"))
    return users.select("user_id", key).join(per, key).groupBy("user_id").agg(F.sum("_n").alias("visible"))


def owned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows that may be inserted: those whose key is owned. A null key is owned by nobody."""
    return rows.join(owners.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, guard: str) -> DataFrame:
    """The table after an upsert: rows with a new key come in, known ones change only where
    the guard column is the same, and then only in what the new row states (not null). Both
    have the same columns and one row for each key."""
    rest = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*rest).alias("_o"))
    n = new.select(key, F.struct(*rest).alias("_n"))
    take = F.col("_o").isNull() | F.coalesce(F.col(f"_o.{guard}") == F.col(f"_n.{guard}"), F.lit(False))
    value = lambda c: F.when(take, F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}"))).otherwise(F.col(f"_o.{c}")).alias(c)
    return o.join(n, key, "full").select(key, *[value(c) for c in rest])


def status_counts(rows: DataFrame, by: list[str], status: str, waiting: list[str]) -> DataFrame:
    """Rows by group and status, and how many of them are past the waiting ones."""
    return rows.groupBy(*by, status).agg(F.count("*").alias("n"), F.count_if(~F.col(status).isin(waiting)).alias("processed"))


def breakdown(rows: DataFrame, name: Column, digits: int = 6) -> DataFrame:
    """Count of each name and its share of all rows."""
    g = rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(total).select("name", "n", F.round(F.col("n") / F.col("total"), digits).alias("share"))  # one row of totals
