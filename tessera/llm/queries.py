"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, debruijn, feistel, grace, hilbert, ledger, lsa, mixing, mtree, simhash, spelling, templates
from .common import load


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search_embeddings(load(spark, sf_dir, "embeddings"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(load(spark, sf_dir, "documents"))


def op3_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.exact_dedup(load(spark, sf_dir, "documents"))


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.substring_dedup(load(spark, sf_dir, "documents"))


def op5_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(load(spark, sf_dir, "documents"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(load(spark, sf_dir, "documents"))


def op7_lsa_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_dedup(load(spark, sf_dir, "documents"), min_docs=2)


def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.secrets(load(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x.kind.isin(*[r.kind for r in ledger.BASE]))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in ledger.BASE],
        F.sha2(ledger.written(base), 256).alias("base_sha256"), ledger.written(F.col("findings")).alias("spans"),
    )


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.alignments(load(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups"), 256))
    return found.select("doc_id", *align.SIZES, digest.alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_mtree_topk, op2_hilbert_shards, op3_grace_dedup, op4_debruijn_dedup, op5_bpe_segment_tree, op6_feistel_pseudonyms, op7_lsa_neighbours, op8_template_tree, op9_gray_simhash, op10_soft_mixing, op11_anagram_variants, op12_blob_ledger, op13_segment_alignment)}

ORACLE_SQL = {
    "op1_mtree_topk": mtree.OP1_SQL,
    "op3_grace_dedup": grace.OP3_SQL,
    "op4_debruijn_dedup": debruijn.OP4_SQL,
    "op11_anagram_variants": spelling.OP11_SQL,
    "op12_blob_ledger": ledger.OP12_SQL,
}
