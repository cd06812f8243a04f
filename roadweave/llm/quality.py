"""Quality classifier by positive-unlabelled learning (operator 5).

A logistic model minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

over trusted positives and unlabelled web text, with an estimated class prior.
Rows labelled 0 are never used as negatives; the training rows only give the
prior, as the share of positives among them.

Features come from the whole text, vectorised over Arrow batches: frequencies
of hashed byte pairs and a few ratios (symbols, capitals, digits, bars, distinct
words, length).  Language, source, id and labels are no inputs.

Fitting sees a bounded sample: at most ``sample_rows`` positives and as many
unlabelled rows, the first by a hash of the id.  Their features (a fixed number
of floats each) are all that reaches the driver; the model is a vector of that
width, shipped in the closure of the scoring stage, which has no shuffle.

Cases: a null text is empty and is scored like the empty text; without
positives, or without unlabelled rows, there is nothing to learn and each score
is the prior (0.5 without labels); a null doc_id is scored too and counts as not
held out; several labels of one id count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import read

PAIR_BINS = 512
RATIOS = 10
WIDTH = PAIR_BINS + RATIOS
SAMPLE_ROWS = 6000
FOLDS = 5
THRESHOLD = 0.3
STEPS = 400
_PAIR_MIX = np.uint32(2654435761)


def held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(text, dtype=np.uint8)
        n = max(1, len(b))
        pairs = np.zeros(PAIR_BINS)
        for i in range(0, len(b) - 1, 1 << 20):  # long texts in steps, so that memory stays small
            part = b[i : i + (1 << 20) + 1]
            code = (part[:-1].astype(np.uint32) << np.uint32(8) | part[1:]) * _PAIR_MIX >> np.uint32(23)
            pairs += np.bincount(code, minlength=PAIR_BINS)
        row[:PAIR_BINS] = np.sqrt(pairs / n)
        seen = np.bincount(b, minlength=256)
        letters = seen[65:91].sum() + seen[97:123].sum()
        words = text.split()
        distinct = len(set(words))
        lines = text.split(b"\n")
        row[PAIR_BINS:] = (
            np.log1p(n) / 10,
            seen[65:91].sum() / max(1, letters),
            seen[48:58].sum() / n,
            seen[[33, 35, 36, 37, 38, 42, 64, 94, 126]].sum() / n * 5,
            seen[124] / n * 10,
            seen[46] / n * 10,
            distinct / max(1, len(words)),
            np.log1p(len(words)) / 10 * (1 - distinct / max(1, len(words))),
            len(set(lines)) / len(lines),
            1 / (1 + len(words) / 8),
        )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Adam on the non-negative risk with logistic loss; where the negative part falls below zero its gradient is turned."""
    rows = len(positives) + len(unlabelled)
    mean = (positives.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / rows
    squares = sum((np.square(x[i : i + 512] - mean)).sum(0) for x in (positives, unlabelled) for i in range(0, len(x), 512))
    scale = np.sqrt(squares / rows) + 0.05
    p, u = (((x - mean.astype(np.float32)) / scale.astype(np.float32)).astype(np.float32, copy=False) for x in (positives, unlabelled))
    w, b = np.zeros(len(mean)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        narrow = w.astype(np.float32)
        zp, zu = (p @ narrow).astype(np.float64) + b, (u @ narrow).astype(np.float64) + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -60, 60))), 1 / (1 + np.exp(-np.clip(zu, -60, 60)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = -prior * (1 - sp) / len(p)  # of prior * loss(z, +1)
        gn_p, gn_u = -prior * sp / len(p), su / len(u)  # of the negative part
        if negative < 0:
            gp, gn_p, gn_u = np.zeros_like(gp), -gn_p, -gn_u
        g = np.concatenate([p.T @ (gp + gn_p).astype(np.float32) + u.T @ gn_u.astype(np.float32) + decay * w, [(gp + gn_p).sum() + gn_u.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(w, b, mean, scale, prior)


def _sampled(docs: DataFrame, ids: DataFrame, key: str, text: str) -> np.ndarray:
    """Features of the rows of ``docs`` with one of ``ids``, which has ``SAMPLE_ROWS`` rows at most."""
    chosen = docs.select(F.col(key).alias("k"), text).join(F.broadcast(ids), "k", "left_semi").select(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([(t or "").encode() for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    found = chosen.mapInArrow(work, "x binary").toArrow().column(0)
    out = np.empty((len(found), WIDTH), dtype=np.float32)
    for row, x in zip(out, found, strict=True):
        row[:] = np.frombuffer(x.as_buffer(), dtype=np.float32)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model | float:
    """A model, or the prior alone where there is nothing to learn from."""
    usable = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(~held_out(F.col("k")) & F.col("k").isNotNull())
    n, ones = usable.filter("y is not null").agg(F.count("y"), F.sum((F.col("y") == 1).cast("long"))).first()
    prior = ones / n if n else 0.5
    by_hash = [F.xxhash64("k"), F.col("k")]
    positives = usable.filter("y = 1").select("k").distinct().orderBy(*by_hash).limit(sample_rows)
    unlabelled = docs.select(F.col(key).alias("k")).filter(~held_out(F.col("k")) & F.col("k").isNotNull()).orderBy(*by_hash).limit(sample_rows)
    p, u = _sampled(docs, positives, key, text), _sampled(docs, unlabelled, key, text)
    if not len(p) or not len(u):
        return float(prior)
    return fit(p, u, min(max(prior, 0.01), 0.99))


def score(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` added (one of that name is replaced)."""
    source = docs.drop("score")
    at = source.columns.index(text)
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at)
            found = [np.zeros(0)]
            for i in range(0, batch.num_rows, 256):
                texts = [(t or "").encode() for t in values.slice(i, 256).to_pylist()]
                found.append(model.score(features(texts).astype(np.float64)) if isinstance(model, Model) else np.full(len(texts), model))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.float64())], [*batch.schema.names, "score"])

    return source.mapInArrow(work, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
