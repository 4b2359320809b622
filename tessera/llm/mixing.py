"""Mixing documents to target domain weights with soft membership.

A softmax classifier fitted to the labelled table gives each document a posterior over
the domains. Rates r >= 0 are then fitted by projected gradient on the least squares

    1/2 |sum over documents of r_i * tokens_i * p_i - target|^2 + rho/2 sum of tokens_i * (r_i - 1)^2,

p_i and target being vectors over the domains; the small second term makes the mix depart
as little as it must from the documents as they are. The iterate is a column of rates. A
pass takes the gradient (for document i: tokens_i times p_i . e + rho (r_i - 1), e the
residual by domain), scales the step on the rates that are free by the inverse of their
second derivatives, keeps those that the gradient presses against zero there, and
projects: r_i <- max(0, r_i - a * step_i). The scaling needs only sums over the domains,
so a pass is one aggregation by Spark; a step that doesn't lower the value is halved."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import numbered_columns, settle, text_bytes, word_bounds, word_hashes
from .lsa import _KIND

_LOG = logging.getLogger(__name__)

DOMAINS = ("clean", "low", "toxic")
#: Share of the tokens that each domain should have.
WEIGHTS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
BUCKETS, STYLES, PER_DOMAIN, PASSES = 4096, 5, 1000, 40
#: Weight of the departure from rate 1, in units of the total of tokens.
RIDGE = 1e-5


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Hashed words (square roots of counts, length 1) and shares of kinds of signs;
    also the number of words."""
    low = text.lower()
    starts, ends = word_bounds(low)
    h = word_hashes(low, starts, ends)
    out = np.zeros(BUCKETS + STYLES, np.float32)
    out[:BUCKETS] = np.sqrt(np.bincount((h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS))
    out[:BUCKETS] /= max(1e-9, np.linalg.norm(out[:BUCKETS]))
    n = max(1, len(text))
    kind = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=4) if text else np.zeros(4)
    repeats = int((h[1:] == h[:-1]).sum()) if len(h) else 0
    out[BUCKETS:] = [1.0, 4 * kind[1] / n, 4 * kind[2] / n, 4 * kind[3] / n, 4 * repeats / max(1, len(h))]
    return out, len(h)


class Softmax:
    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, steps: int = 300, decay: float = 2e-5) -> None:
        """Weighted multinomial logistic regression by Nesterov's gradient method; classes
        without examples get no mass."""
        self.seen = np.bincount(y, minlength=classes) > 0
        idf = np.ones(x.shape[1], np.float32)
        idf[:BUCKETS] = np.log((1 + len(x)) / (1 + (x[:, :BUCKETS] > 0).sum(0)))
        x, w = (x * idf).astype(np.float32), np.zeros((x.shape[1], classes), np.float32)
        want = np.eye(classes, dtype=np.float32)[y]
        weight = (weight / weight.sum()).astype(np.float32)
        rate = 1 / (0.5 * float((weight * (x**2).sum(1)).sum()) + decay)
        ahead, last = w, w
        for i in range(steps):
            p = self._soft(x @ ahead)
            grad = x.T @ ((p - want) * weight[:, None]).astype(np.float32) + np.float32(decay) * ahead
            w = ahead - np.float32(rate) * grad
            ahead = w + np.float32(i / (i + 3)) * (w - last)
            last = w
        self.w = (w * idf[:, None]).astype(np.float32)

    def _soft(self, z: np.ndarray) -> np.ndarray:
        z = np.where(self.seen, z, -1e9)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self._soft((x @ self.w).astype(np.float64))


def domain_of() -> "F.Column":
    """Domain of a row of labels; null if it has no label."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


def fit_domains(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> Softmax | None:
    """Fits on at most per_domain labelled documents of each domain (the first in the
    order of a hash), weighted to the domains' shares of all labels. None without labels."""
    named = labels.where("doc_id is not null").select("doc_id", domain_of().alias("domain")).where("domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    shares = {r[0]: r[1] for r in named.groupBy("domain").count().collect()}
    chosen = None
    for d in sorted(shares):
        part = named.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return None
    # at most 3 * per_domain rows of two numbers: a proven bound
    joined = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = [features(t.as_py())[0].astype(np.float16).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("domain"), pa.array(rows, pa.binary())], names=["doc_id", "domain", "x"])

    got = joined.mapInArrow(run, f"doc_id {key}, domain int, x binary").orderBy("doc_id", "x").limit(2 * len(DOMAINS) * per_domain).collect()
    if not got:
        return None
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32)
    y = np.array([r.domain for r in got])
    weight = np.array([shares[d] for d in y.tolist()], float) / np.bincount(y, minlength=len(DOMAINS))[y]
    return Softmax(x, y, weight, len(DOMAINS))


def memberships(docs: DataFrame, model: Softmax | None, text: str = "text", keep: bool = False) -> DataFrame:
    """docs with tokens (words) and p_<domain>, its text column at the end before those, or
    left out unless keep; without a model all domains are alike. Column names are distinct."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[c for c in docs.columns if c != text], text)
    kept = plain.columns if keep else plain.columns[:-1]
    schema = T.StructType([plain.schema[c] for c in kept] + [T.StructField("tokens", T.LongType())] + [T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS])
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [features((t.as_py() or "").encode()) for t in part.column(part.num_columns - 1)]
                x = np.array([g[0] for g in got])
                p = np.full((len(got), len(DOMAINS)), 1 / len(DOMAINS)) if shared.value is None else np.round(shared.value.posteriors(x), 6)
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(i).type) for i in range(len(kept))], pa.array([g[1] for g in got], pa.int64()), *[pa.array(p[:, i]) for i in range(len(DOMAINS))]], schema=arrow)

    return plain.mapInArrow(run, schema)


class Rates:
    """Rates as the steps that led to them: on() gives any table with tokens and p_<domain>
    the column _r. errors: relative size of the projected gradient before each pass; missed:
    by how much each domain misses its target, as a share of all targets."""

    def __init__(self, rho: float) -> None:
        self.rho, self.steps, self.errors, self.missed = rho, [], [], {}

    @staticmethod
    def along(v: np.ndarray) -> "F.Column":
        out = F.lit(0.0)
        for d, x in zip(DOMAINS, v.tolist(), strict=True):
            out = out + F.col(f"p_{d}") * F.lit(float(x))
        return out

    def gradient(self, e: np.ndarray) -> "F.Column":
        return self.along(e) + F.lit(self.rho) * (F.col("_r") - 1)

    def pressed(self, e: np.ndarray) -> "F.Column":
        """Rates at zero that the gradient keeps there."""
        return (F.col("_r") <= 0) & (self.gradient(e) > 0)

    def stepped(self, df: DataFrame, e: np.ndarray, w: np.ndarray, a: float) -> DataFrame:
        r = F.col("_r")
        return df.withColumn("_r", F.when(self.pressed(e), 0.0).otherwise(F.greatest(F.lit(0.0), r - F.lit(a) * (r - 1 + self.along(w)))))

    def on(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_r", F.lit(1.0))
        for step in self.steps:
            out = self.stepped(out, *step)
        return out


def rates(table: DataFrame, targets: dict[str, float], passes: int = PASSES, tolerance: float = 1e-7, ridge: float = RIDGE) -> Rates:
    """Fits the rates of the rows of table (columns tokens and p_<domain>, settled). Targets are
    token totals by domain; where they can't be met (nobody belongs to a domain) the least
    squares leave a residual, which is returned and logged."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = len(DOMAINS)
    goal = np.array([targets[d] for d in DOMAINS])
    scale = max(float(np.abs(goal).sum()), 1e-9)
    table = table.select("tokens", *[f"p_{d}" for d in DOMAINS])
    total = max(float(table.agg(F.sum("tokens")).first()[0] or 0), 1.0)
    out, r, t = Rates(ridge * total), F.col("_r"), F.col("tokens")

    def residual(frame: DataFrame) -> tuple[np.ndarray, float]:
        v = np.array([x or 0.0 for x in frame.agg(*[F.sum(r * t * c) for c in p], F.sum(t * (r - 1) * (r - 1))).first()])
        e = v[:n] - goal
        return e, 0.5 * float(e @ e) + 0.5 * out.rho * v[n]

    now, a = out.on(table), 1.0
    e, value = residual(now)
    for k in range(passes):
        free = F.when(out.pressed(e), 0.0).otherwise(t)
        row = now.agg(*[F.sum(free * p[i] * p[j]) for i in range(n) for j in range(n)], *[F.sum(free * c * (r - 1)) for c in p], F.sum(free / total * (out.gradient(e) / scale) ** 2)).first()
        v = np.array([x or 0.0 for x in row])
        out.errors.append(float(np.sqrt(v[-1])))
        if out.errors[-1] < tolerance:
            break
        # Woodbury: the inverse second derivatives on the free rates, from sums over the domains
        w = np.linalg.solve(v[: n * n].reshape(n, n) + out.rho * np.eye(n), e - v[n * n : n * n + n])
        moved = False
        while a > 1e-4 and not moved:
            new = out.stepped(now, e, w, a)
            new = settle(new) if k % 8 == 7 else new
            new_e, new_value = residual(new)
            moved = new_value <= value * (1 + 1e-12)
            if moved:
                out.steps.append((e, w, a))
            a = min(1.0, 2 * a) if moved else a / 2
        if not moved:
            break
        now, e, value = new, new_e, new_value
    out.missed = {d: float(abs(x)) / scale for d, x in zip(DOMAINS, e.tolist(), strict=True)}
    if max(out.missed.values()) > 1e-3:
        _LOG.warning("targets are missed by these shares of all target tokens: %s", out.missed)
    return out


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None) -> DataFrame:
    """One row per document: doc_id, tokens, p_clean, p_low, p_toxic, rate, and missed, the
    largest share of all tokens by which a domain misses its target (alike in every row: 0 or
    nearly, unless the targets can't be met). The rates give each domain its share of `total`
    expected tokens (all tokens of docs if None). Null and empty texts have no tokens and the
    rate of their posterior; repeated rows have equal rates; an empty table gives no rows."""
    table = settle(memberships(docs.select("doc_id", "text"), fit_domains(docs, labels)))
    tokens = table.agg(F.sum("tokens")).first()[0] or 0
    found = rates(table, {d: w * (tokens if total is None else total) for d, w in weights.items()})
    return found.on(table).select("doc_id", "tokens", *[f"p_{d}" for d in DOMAINS], F.round("_r", 9).alias("rate"), F.lit(round(max(found.missed.values()), 9)).alias("missed"))


#: In the pipeline: how often the clean tokens are to be seen, and the most that the
#: other domains may have of the clean tokens.
EPOCHS, MOST = 1.25, {"low": 0.05, "toxic": 0.05}


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, each as often as its rate says: the whole part, and once more if a
    hash of doc_id and text falls into the fraction, so the same documents are chosen wherever
    and however often this runs. Clean tokens are to be seen EPOCHS times, so a document that
    is clean stays at least once; other domains get what they have, up to MOST. Each row has
    its own rate: rows without doc_id, or that share one, are judged by their texts, rows
    that are wholly alike are drawn alike. The columns are those of docs, whatever their
    names; null and empty texts have the rate of their posterior; an empty table stays empty."""
    plain, back = numbered_columns(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    table = settle(memberships(plain, fit_domains(docs, labels), text, keep=True))
    have = table.agg(*[F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first().asDict()
    clean = EPOCHS * (have["clean"] or 0.0)
    goal = {"clean": clean} | {d: min(have[d] or 0.0, m * clean) for d, m in MOST.items()}
    chance = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("_r") + chance).cast("int")
    return rates(table, goal).on(table).withColumn("_again", F.explode(F.array_repeat(F.lit(1), times))).select(*back)
