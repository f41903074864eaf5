"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text are all the training needs; labels of
bad documents are never read. The share of good documents among the unlabelled
ones is estimated first, by the threshold at which the share of unlabelled
documents above it is smallest against that of the positives. A logistic model of
byte and word statistics then minimises the non-negative unbiased risk: the loss
of unlabelled documents as negatives, less that of the positives hidden among
them, is not allowed below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches
from choicelab.llm.labelled import bounded_sample, held_out, with_labels
from choicelab.llm.text import Slice, shingles, slices, words

FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
#: Most positives and most unlabelled documents that a model is fitted on.
SAMPLE_ROWS = 6000
STEPS = 400
RATE = 0.05
PENALTY = 1e-3
_KIND = np.full(256, 5, np.int64)  # lower, upper, digit, blank, line end, mark, byte of a longer character
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 0, 1, 2, 3, 4, 6
FEATURES = 128 + 1 + 49 + 5


def features(part: Slice) -> np.ndarray:
    """Statistics of the bytes and words of each text, one row per text."""
    found = words(part)
    lengths = found.ends - found.starts
    kinds = _KIND[part.data]
    out = np.zeros((len(part), FEATURES), np.float32)
    for t, own in enumerate(shingles(part, 3)):
        a, b = part.offsets[t], part.offsets[t + 1]
        w = lengths[found.first[t]:found.first[t + 1]]
        n = max(1, int(b - a))
        by_byte = np.bincount(part.data[a:b], minlength=256)
        out[t, :128] = np.log1p(1000 * by_byte[:128] / n)
        out[t, 128] = by_byte[128:].sum() / n
        if b - a > 1:
            out[t, 129:178] = np.bincount(kinds[a:b - 1] * 7 + kinds[a + 1:b], minlength=49) / n
        if len(w):
            out[t, 178:] = np.log(len(w)), w.mean(), w.std(), len(own) / max(1, len(w) - 2), w.max() ** 0.5
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class _Steps:
    """Adam steps for one vector of parameters."""

    def __init__(self, n: int):
        self.w, self._m, self._v, self._t = np.zeros(n), np.zeros(n), np.zeros(n), 0

    def take(self, gradient: np.ndarray) -> None:
        self._t += 1
        self._m = 0.9 * self._m + 0.1 * gradient
        self._v = 0.999 * self._v + 0.001 * gradient**2
        self.w -= RATE * self._m / (1 - 0.9**self._t) / (np.sqrt(self._v / (1 - 0.999**self._t)) + 1e-8)


def fit_against(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Logistic weights that tell positives from unlabelled rows; a constant is the last column."""
    steps = _Steps(positive.shape[1])
    for _ in range(STEPS):
        g = -positive.T @ _sigmoid(-(positive @ steps.w)) / len(positive) + unlabelled.T @ _sigmoid(unlabelled @ steps.w) / len(unlabelled)
        steps.take(g + PENALTY * steps.w)
    return steps.w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows from scores, by the best bin at the top."""
    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 0.995, 400)))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    spread = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    usable = p > 0.05
    best = np.argmin((u[usable] + 1.01 * spread) / p[usable])
    return float(np.clip(u[usable][best] / p[usable][best], 0.05, 0.98))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights at the minimum of the non-negative unbiased risk with logistic loss."""
    steps = _Steps(positive.shape[1])
    for _ in range(STEPS):
        zp, zu = positive @ steps.w, unlabelled @ steps.w
        as_positive = -prior * (positive.T @ _sigmoid(-zp)) / len(zp)
        as_negative = unlabelled.T @ _sigmoid(zu) / len(zu) - prior * (positive.T @ _sigmoid(zp)) / len(zp)
        risk = _softplus(zu).mean() - prior * _softplus(zp).mean()
        steps.take((as_positive + as_negative if risk >= 0 else -as_negative) + PENALTY * steps.w)
    return steps.w


class Model:
    """Centre and scale of the statistics, weights, and the prior; ``fit`` is deterministic."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        both = np.concatenate([positive, unlabelled]).astype(np.float64)
        self.centre, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        p, u = self._scaled(positive), self._scaled(unlabelled)
        half = fit_against(p[::2], u[::2])
        self.prior = estimate_prior(p[1::2] @ half, u[1::2] @ half) if len(p) > 1 and len(u) > 1 else 0.5
        self.weights = fit_non_negative(p, u, self.prior)

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((rows - self.centre) / self.scale, -8, 8), np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self._scaled(rows) @ self.weights)


def _feature_rows(texts: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f.tobytes() for part in slices(batch.column("text")) for f in features(part)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(rows, pa.binary())], names=[*columns, "features"])

    schema = ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in columns) + ", features binary"
    return texts.select(*columns, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from at most about SAMPLE_ROWS positives and as many unlabelled rows; none without either."""
    bound_batches(docs.sparkSession)
    rows = with_labels(docs, labels, "quality", FOLDS, FOLD)
    sample = bounded_sample(rows, {"positive": F.col("label") == 1, "unlabelled": F.col("label").isNull()}, SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # bounded by SAMPLE_ROWS
    got = sorted((r["part"], r["doc_id"], bytes(r["features"])) for r in _feature_rows(texts, ["doc_id", "part"]).collect())
    split = {part: np.frombuffer(b"".join(f for p, _, f in got if p == part), np.float32).reshape(-1, FEATURES) for part in ("positive", "unlabelled")}
    return Model(**split) if all(map(len, split.values())) else None


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, null text being empty; 0.5 without a model."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(features(part)) if model else np.full(len(part), 0.5) for part in slices(batch.column("text"))]
            score = np.concatenate([*found, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model trained on them accepts, with all their columns.

    ``docs`` may have any further columns; the score is added to the row, so nothing is joined.
    """
    model = train(docs, labels)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(features(part)) if model else np.ones(len(part)) for part in slices(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([*found, np.zeros(0)]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
