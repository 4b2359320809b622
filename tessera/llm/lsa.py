"""Quality by nearest neighbours in a latent-semantic space.

A bounded sample of labelled documents gives hashed character trigrams, weighted by
inverse document frequency and projected by a truncated SVD. The sample's vectors and
the projection are broadcast; each document's cosines with all of them are computed in
blocks, and the labels of the nearest are weighted by similarity."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_columns, text_bytes

BUCKETS, RANK, NEIGHBOURS = 2048, 48, 15
#: Labelled documents of each class that the model keeps: the bound on the fit and
#: on what is broadcast (2 * PER_CLASS * RANK floats and BUCKETS * RANK floats).
PER_CLASS = 1000
THRESHOLD = 0.3
_STYLES = 6


def features(text: bytes) -> np.ndarray:
    """Square roots of hashed trigram counts, and a few shares of the whole text."""
    a = np.frombuffer(b" " + text + b"  ", np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)
    h = (h ^ h >> np.uint32(11)) & np.uint32(BUCKETS - 1)
    out = np.zeros(BUCKETS + _STYLES, np.float32)
    out[:BUCKETS] = np.sqrt(np.bincount(h, minlength=BUCKETS))
    out[:BUCKETS] /= np.linalg.norm(out[:BUCKETS])
    n = max(1, len(text))
    kind = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=4) if text else np.zeros(4)
    words = text.split()
    out[BUCKETS:] = 0.5 * np.array([kind[1] / n, kind[2] / n, kind[3] / n, 1 - len(set(words)) / max(1, len(words)), 1.0 / (1 + len(words)), 3 * sum(map(eq, words, words[1:])) / max(1, len(words))])
    return out


_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 2
_KIND[48:58] = 3


class Model:
    """weights: of the features; basis: features x rank; vectors and labels of the
    labelled sample; prior: the score where nothing can be told."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK, prior: float = 0.5) -> None:
        self.prior, self.labels = prior, labels.astype(np.float32)
        if not len(x) or len(set(labels.tolist())) < 2:
            self.basis = None
            return
        df = (x[:, :BUCKETS] > 0).sum(0)
        self.weights = np.ones(x.shape[1], np.float32)
        self.weights[:BUCKETS] = np.log((1 + len(x)) / (1 + df)) + 0.2
        rank = min(rank, *x.shape)
        _, _, vt = np.linalg.svd(x * self.weights, full_matrices=False)
        self.basis = (vt[:rank].T * self.weights[:, None]).astype(np.float32)
        self.vectors = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        if self.basis is None or not len(x):
            return np.full(len(x), self.prior)
        cosine = self.latent(x) @ self.vectors.T
        k = min(k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-6) ** 4
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def in_training(doc_id: str = "doc_id") -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def sample_features(docs: DataFrame, labels: DataFrame, label: "F.Column", per_class: int = PER_CLASS, kinds: tuple = (0, 1)) -> tuple[np.ndarray, list]:
    """Features and labels of at most per_class labelled documents of each class in
    `kinds`, the first in the order of a hash of doc_id; rows without such a label or
    without doc_id are left out, repeated labels count once (the smallest label)."""
    found = labels.where(F.col("doc_id").isNotNull()).select("doc_id", label.alias("_label")).where(F.col("_label").isin(*kinds)).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    chosen = None
    for kind in kinds:
        part = found.where(F.col("_label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most len(kinds) * per_class rows of two numbers: a proven bound
    joined = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = [features(t.as_py()).astype(np.float16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    key = docs.schema["doc_id"].dataType.simpleString()
    kind = chosen.schema["_label"].dataType.simpleString()
    got = joined.mapInArrow(run, f"doc_id {key}, label {kind}, x binary").orderBy("doc_id", "x").limit(2 * per_class * len(kinds)).collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), BUCKETS + _STYLES)
    return x, [r.label for r in got]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    x, y = sample_features(docs, labels.where(in_training()), F.col("quality").cast("int"), per_class)
    return Model(x, np.array(y, np.int64))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with `score` (0 to 1). Null texts count as empty and are
    scored like any other; with no labels or only one class every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        out = np.zeros(len(texts))
        for lo in range(0, len(texts), 256):
            block = [bytes(t) for t in texts.iloc[lo : lo + 256]]
            out[lo : lo + 256] = shared.value.score(np.array([features(t) for t in block]))
        import pandas as pd

        return pd.Series(np.round(out, 9))

    return docs.withColumn("score", score(text_bytes()))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Null and empty texts are scored
    like any other (by the shares that an empty text has); very long ones are read whole. A
    null doc_id hashes as the empty string. Labels other than 0 and 1 don't count; of
    several labels of a document the smallest does. Repeated rows get equal scores (and a
    labelled one that repeats stands in the sample as often); without labels of both
    classes every score is 0.5; an empty table gives no rows."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts (score of THRESHOLD or more), with the
    columns of docs, whatever their names. The rules are those of quality(); nothing but the
    text decides."""
    model = fit_quality(docs, labels)
    plain, back = numbered_columns(docs, "text")
    return score_quality(plain, model).where(F.col("score") >= THRESHOLD).select(*back)
