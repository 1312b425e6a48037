"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has a rate of its own and L1 keeps most weights at exactly zero; what is left is a
short list of weights that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import raw_bytes, texts_in, words_of, written
from undertow.llm.jaccard import WordHashes, mix

DIM_BITS = 20
#: Labelled rows that the fit may use, at most about; chosen by a hash of the key.
TRAIN_ROWS = 12_000


class Settings(NamedTuple):
    """Rate, its offset, L1, L2 and passes over the sample."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    passes: int = 5


#: Of 40 settings that of least log loss in ``cross_validate`` over training labels; held-out labels had no part in it.
SETTINGS = Settings()


def features(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Coordinates of a text's words, pairs of neighbours and pairs around one word."""
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pair = mix(h[:-1] * np.uint64(3) + h[1:])
    skip = mix(h[:-2] * np.uint64(5) + h[2:])
    return (np.concatenate((h, pair, skip)) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


class Ftrl:
    def __init__(self, settings: Settings, dim: int = 1 << DIM_BITS) -> None:
        self.s = settings
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)  # the last one is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        """One row: ``at`` are its distinct coordinates, each of value 1."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def learnt(rows: list[tuple[int, bytes]], settings: Settings) -> Ftrl:
    """A model of the rows (label, distinct coordinates), learnt in their order."""
    model = Ftrl(settings)
    for _ in range(settings.passes):
        for y, x in rows:
            model.learn(np.frombuffer(x, np.int32), int(y > 0))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The sample that a fit may use (see TRAIN_ROWS): order ``o``, label ``y``, distinct coordinates ``x``.

    Labels of one key that differ count as the larger; null labels and keys are left out.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    share = min(1.0, TRAIN_ROWS / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(F.xxhash64(key).alias("o"), "_y", text)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in texts_in(batches):
            x = [np.unique(features(words_of(raw), hashes)).astype(np.int32) for raw in raw_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("_y"), pa.array([v.tobytes() for v in x], pa.binary())], names=["o", "y", "x"])

    return written(rows.mapInArrow(featurise, "o long, y int, x binary"), "toxicity-sample")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = SETTINGS
) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights, the bias last, learnt by one task from ``training_rows`` in an order given by a hash."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("y").to_pylist(), b.column("x").to_pylist(), strict=True)]
        w = learnt(rows, settings)
        w = w.weights(np.arange(len(w.z)))
        at = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w[at].astype("<f8").tobytes()], pa.binary())], names=["at", "w"])

    sample = training_rows(docs, labels, key=key, text=text, label=label)
    told = sample.repartition(1).sortWithinPartitions("o", "x").mapInArrow(learn, "at binary, w binary").collect()
    if not told:
        return np.array([1 << DIM_BITS], "<i4"), np.zeros(1)
    return np.frombuffer(told[0]["at"], "<i4"), np.frombuffer(told[0]["w"], "<f8")


def cross_validate(docs: DataFrame, labels: DataFrame, grid: list[Settings], *, folds: int = 3, threshold: float = 0.3) -> DataFrame:
    """For each of ``grid``: rows, log loss, precision and recall at ``threshold``, over folds of ``labels`` alone.

    Equal texts fall into one fold. Give it the labels that a fit may see, never held-out ones.
    """
    sample = training_rows(docs, labels)
    tried = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in s._asdict().items())) for s in grid))).alias("s")

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        settings, fold = Settings(*(v.as_py() for v in key)), np.asarray(rows.column("fold"))
        y, x = rows.column("y").to_pylist(), rows.column("x").to_pylist()
        order = np.argsort(np.asarray(rows.column("o")), kind="stable")
        p, truth = np.zeros(len(y)), np.array(y) > 0
        for f in range(folds):
            model = learnt([(y[i], x[i]) for i in order if fold[i] != f], settings)
            w = model.weights(np.arange(len(model.z)))
            for i in np.flatnonzero(fold == f):
                p[i] = 1.0 / (1.0 + np.exp(-np.clip(w[np.frombuffer(x[i], np.int32)].sum() + w[-1], -35, 35)))
        said, q = p >= threshold, np.clip(np.where(truth, p, 1 - p), 1e-9, 1.0)
        hit = int((said & truth).sum())
        found = [len(y), float(-np.log(q).mean()), hit / max(1, int(said.sum())), hit / max(1, int(truth.sum()))]
        names = ["rows", "log_loss", "precision", "recall"]
        return pa.table({**{k: [v] for k, v in settings._asdict().items()}, **{k: [v] for k, v in zip(names, found, strict=True)}})

    rows = sample.select("o", "y", "x", F.pmod(F.xxhash64("x"), F.lit(folds)).alias("fold"), tried).select("*", "s.*").drop("s")
    shape = "alpha double, beta double, l1 double, l2 double, passes long, rows long, log_loss double, precision double, recall double"
    return rows.groupBy(*Settings._fields).applyInArrow(judge, shape)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``score``, the chance of label 1. Null and empty texts get the bias's score.

    ``columns`` names those of ``docs`` to return (all by default); a column ``score`` is replaced.
    """
    keep = [c for c in (columns or docs.columns) if c != "score"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (at, w) = WordHashes(), shared.value
        weights = np.zeros(1 << DIM_BITS)
        weights[at[:-1]] = w[:-1]
        used = weights != 0
        for batch in texts_in(batches):
            sums = []
            for raw in raw_bytes(batch.column(text)):
                x = features(words_of(raw), hashes)
                sums.append(weights[np.unique(x[used[x]])].sum())
            score = 1.0 / (1.0 + np.exp(-np.clip(np.array(sums) + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op2's contract: learns from labels outside the held-out fold only."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_toxicity(docs, labels.where(~held))
    told = score_toxicity(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return told.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
