"""Toxicity by multiple-instance learning.

A document is a bag of sentences; it is toxic unless every sentence is clean, so
its probability is the noisy-or of the sentences' ones. Only document labels are
known. The gradient of the noisy-or gives each sentence its share of the blame,
and the trained sentence scores then point out the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches
from choicelab.llm.labelled import bounded_sample, held_out, with_labels
from choicelab.llm.text import RangeHasher, Slice, slices
from choicelab.staging import stage

FOLDS, FOLD = 5, 0
THRESHOLD = 0.5
#: Most documents of either label that a model is fitted on.
SAMPLE_ROWS = 8000
#: Most features with a weight; the fewest toxic documents that show one, and by how many deviations they exceed chance.
WEIGHTS = 4096
SUPPORT = 3
APART = 4.0
PREFIX = 5
STEPS = 300
RATE = 0.2
PENALTY = 1e-5
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


@dataclass
class Bags:
    """Features of a slice: 32-bit hashes, the sentence of each, the text of each sentence, its byte range."""

    codes: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(part: Slice) -> Bags:
    """Words (letters and digits, A-Z lowered) and their prefixes by sentence.

    A sentence ends after . ! ? or a line end, and with its text.
    """
    part = part.lowered()
    n = len(part.data)
    stops = np.flatnonzero(_END[part.data]) + 1
    edges = np.unique(np.concatenate([part.offsets, stops]))
    edges = edges if len(edges) > 1 else np.array([0, 0])
    inside = _INSIDE[part.data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    own = part.offsets[(part.offsets > 0) & (part.offsets < n)]
    before[own] = False
    after[own - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hasher = RangeHasher(part.data)
    long_ = np.flatnonzero(ends - starts > PREFIX)
    prefix = (hasher(starts[long_], starts[long_] + PREFIX) ^ np.uint64(0x5BF03635)) >> np.uint64(32)
    codes = np.concatenate([hasher(starts, ends) >> np.uint64(32), prefix]).astype(np.uint32)
    sentence = np.searchsorted(edges, starts, "right") - 1
    return Bags(codes, np.concatenate([sentence, sentence[long_]]), np.searchsorted(part.offsets, edges[:-1], "right") - 1, edges[:-1], edges[1:])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    """Weights of hashed features, and the level of a sentence without any."""

    def __init__(self, codes: np.ndarray, docs: list[tuple[int, np.ndarray, np.ndarray, int]]):
        """``codes``: sorted features; ``docs``: label, place of each feature in ``codes``, its sentence, number of sentences."""
        self.codes = codes
        label = np.array([d[0] for d in docs], float)
        doc = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
        place = np.concatenate([d[1] for d in docs]).astype(np.int64)
        base = np.concatenate([[0], np.cumsum([d[3] for d in docs])])
        sentence = np.concatenate([d[2] for d in docs]) + base[doc]
        marked, row = np.unique(sentence, return_inverse=True)
        of = np.searchsorted(base, marked, "right") - 1
        plain = np.diff(base) - np.bincount(of, minlength=len(docs))
        self.weights, self.level = self._fit(place, row, of, plain, label)
        self._table()

    def _table(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.codes & np.uint32(0xFFFF)] = True

    def _fit(self, place, row, of, plain, label) -> tuple[np.ndarray, float]:
        n = len(self.codes)
        w = np.zeros(n + 1)
        w[-1] = -5.0
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        weight = 1 / len(label)
        for t in range(1, STEPS + 1):
            z = w[-1] + np.bincount(row, weights=w[place], minlength=len(of))
            total = np.bincount(of, weights=_softplus(z), minlength=len(label)) + plain * _softplus(w[-1])
            blame = weight * np.where(label == 1, -1 / np.expm1(np.clip(total, 1e-6, 700)), 1.0)
            share = blame[of] * _sigmoid(z)
            g = np.append(np.bincount(place, weights=share[row], minlength=n), share.sum() + (blame * plain).sum() * _sigmoid(w[-1]))
            g[:-1] += PENALTY * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= RATE * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        return w[:-1], float(w[-1])

    def sentences(self, found: Bags) -> np.ndarray:
        """Log odds of each sentence."""
        z = np.full(len(found.text), self.level)
        near = np.flatnonzero(self.seen[found.codes & np.uint32(0xFFFF)])
        if len(near) and len(self.codes):
            place = np.minimum(np.searchsorted(self.codes, found.codes[near]), len(self.codes) - 1)
            hit = self.codes[place] == found.codes[near]
            z += np.bincount(found.sentence[near[hit]], weights=self.weights[place[hit]], minlength=len(z))
        return z


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from at most about SAMPLE_ROWS documents of each label; none unless both labels occur."""
    bound_batches(docs.sparkSession)
    rows = with_labels(docs, labels, "toxic", FOLDS, FOLD)
    sample = bounded_sample(rows, {"1": F.col("label") == 1, "0": F.col("label") == 0}, SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # bounded by SAMPLE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, where, counts = [], [], []
            for part in slices(batch.column("text")):
                found = bags(part)
                of = found.text[found.sentence]
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(len(part) + 1))
                first = np.searchsorted(found.text, np.arange(len(part) + 1))
                for t in range(len(part)):
                    own = order[cut[t]:cut[t + 1]]
                    codes.append(found.codes[own].tobytes())
                    where.append((found.sentence[own] - first[t]).astype(np.int32).tobytes())
                    counts.append(first[t + 1] - first[t])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(codes, pa.binary()), pa.array(where, pa.binary()), pa.array(counts, pa.int64())],
                                             names=["doc_id", "part", "codes", "sentences", "n"])

    bagged = stage(texts.select("doc_id", "part", "text").mapInArrow(run, "doc_id long, part string, codes binary, sentences binary, n long"), "bags")
    sizes = {r["part"]: r["count"] for r in bagged.groupBy("part").count().collect()}
    if len(sizes) < 2:
        return None
    codes = _select(bagged, sizes["1"], sizes["0"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, where = [], []
            for own, sentences in zip(batch.column("codes").to_pylist(), batch.column("sentences").to_pylist()):
                own = np.frombuffer(own, np.uint32)
                place = np.searchsorted(codes, own)
                hit = codes[np.minimum(place, len(codes) - 1)] == own if len(codes) else np.zeros(len(own), bool)
                places.append(place[hit].astype(np.int32).tobytes())
                where.append(np.frombuffer(sentences, np.int32)[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(places, pa.binary()), pa.array(where, pa.binary()), batch.column("n")],
                                             names=["doc_id", "part", "places", "sentences", "n"])

    got = sorted(tuple(r) for r in bagged.mapInArrow(known, "doc_id long, part string, places binary, sentences binary, n long").collect())
    return Model(codes, [(int(p), np.frombuffer(c, np.int32), np.frombuffer(s, np.int32), n) for _, p, c, s, n in got])


def _select(bagged: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """The at most WEIGHTS features whose toxic documents most exceed chance, by code."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("codes").to_pylist()):
                own = np.unique(np.frombuffer(own, np.uint32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), int(part), np.int32))], names=["code", "toxic"])

    share = toxic / (toxic + clean)
    counts = bagged.mapInArrow(distinct, "code long, toxic int").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    apart = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = counts.filter(F.col("toxic") >= SUPPORT).withColumn("apart", apart).filter(F.col("apart") >= APART).orderBy(F.desc("apart"), "code").limit(WEIGHTS)
    return np.sort(np.array([r["code"] for r in best.select("code").collect()], np.uint32))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending for every row.

    ``offending`` lists the sentences of probability 0.5 or more as start, end (code
    points, end exclusive) and probability. Null text is empty; without a model the
    score is 0. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, spans = [np.zeros(0)], [np.zeros(0, np.int64)], []
            for part in slices(batch.column("text")):
                found = bags(part)
                z = model.sentences(found) if model else np.full(len(found.text), -np.inf)
                inside = found.text < len(part)
                scores.append(-np.expm1(-np.bincount(found.text[inside], weights=_softplus(z[inside]), minlength=len(part))))
                counts.append(np.bincount(found.text[inside], minlength=len(part)))
                spans += _spans(part, found, z)
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                 pa.array(np.concatenate(counts)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,score:double>>")


def _spans(part: Slice, found: Bags, z: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(part))]
    bad = np.flatnonzero(z >= 0)
    if len(bad):
        points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
        for s in bad.tolist():
            t = int(found.text[s])
            zero = points[part.offsets[t]]
            out[t].append({"start": int(points[found.start[s]] - zero), "end": int(points[found.end[s]] - zero), "score": float(_sigmoid(z[s]))})
    return out
