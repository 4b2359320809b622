"""The corpus pipeline: quality, exact and near duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, grace, lsa, mixing, simhash
from tessera.llm.common import load, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier accepts. Only the text decides: null
    and empty texts are scored like others, repeated rows go or stay alike, a null doc_id does
    no harm, very long texts are read whole, an empty table stays empty; further columns,
    whatever their names, stay as they are. Without labels of both classes all stay."""
    return lsa.keep_good(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space apart): the one with most code
    points, then the smallest doc_id; a null doc_id comes last, of wholly equal rows one
    stays. Null and empty texts are one group; an empty table stays empty; further columns
    stay as they are."""
    return grace.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard 0.8 or
    more; the smallest doc_id stays, with all rows that have it; null and empty texts are
    one component. An empty table stays empty; further columns stay as they are."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them, each row by its own rate, chosen by a hash
    of doc_id and text: rows that are wholly alike are drawn alike, null ids and texts are
    drawn like others. An empty table stays empty; further columns stay as they are."""
    return mixing.resample(docs, load(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining row; null and empty texts have no tokens,
    very long ones are encoded whole, repeated rows come out repeated."""
    return bpe.tokenize(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: No SQL can express the stages that fit a model; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
