"""Quality scores by a convolutional network over the bytes of whole texts.

Learned filters look at every window of 6 bytes. The largest answer of each filter within a chunk of 512 bytes is
the chunk's reading; chunks overlap by half, and the last one ends with the text, so each byte is covered. A small
layer turns a chunk's reading into units, and the units' maxima and means over all chunks of a text give one
probability by a logistic output. All of it is numpy; a text is read in slices, so that a task holds a slice's
answers only, however long the text.

Defined results: null and empty texts count as one window of zero bytes and get that window's score. Labels of one
key that differ count as the larger; null labels and keys are left out. Without any label every score is 0.5. Rows
repeated with one text get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import raw_bytes, texts_in, written

WIDTH, FILTERS, UNITS = 6, 16, 12
HALF = 256  # a chunk has two halves, and its second one is the next chunk's first
SLICE = 512 * HALF  # windows that are answered together
#: Labelled rows that the fit may use, at most about; chosen by a hash of the key.
TRAIN_ROWS = 6_000
EPOCHS, STEP, RATE, DECAY = 6, 32, 0.01, 1e-5
SHAPES = {"filters": (WIDTH, 256, FILTERS), "bias": (FILTERS,), "layer": (FILTERS, UNITS), "layer_bias": (UNITS,), "out": (2 * UNITS,), "out_bias": (1,)}

Params = dict[str, np.ndarray]


def start(seed: int = 12) -> Params:
    rng = np.random.default_rng(seed)
    scale = {"filters": 0.1, "layer": (2 / FILTERS) ** 0.5, "out": 0.1}
    return {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


class Filters:
    """The filters as tables over pairs of bytes: a window's answer is a sum of three rows."""

    def __init__(self, filters: np.ndarray) -> None:
        self.pairs = [(filters[w][:, None] + filters[w + 1][None]).reshape(1 << 16, -1) for w in range(0, WIDTH, 2)]

    def halves(self, text: bytes | None, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """The largest answers (halves x filters), where they are if asked for, and the padded bytes."""
        text = text or b"\0"
        x = np.frombuffer(text + b"\0" * WIDTH, np.uint8)
        pair = x[:-1].astype(np.int32) * 256 + x[1:]
        top, at = [], []
        for begin in range(0, len(text), SLICE):
            n = min(SLICE, len(text) - begin)
            answer = self.pairs[0].take(pair[begin : begin + n], axis=0)
            for k, table in enumerate(self.pairs[1:], 1):
                answer += table.take(pair[begin + 2 * k : begin + 2 * k + n], axis=0)
            full = n // HALF
            whole = answer[: full * HALF].reshape(full, HALF, answer.shape[1])
            rest = answer[full * HALF :]
            top += [whole.max(1)] if full else []
            top += [rest.max(0)[None]] if len(rest) else []
            if places:
                first = begin + np.arange(full)[:, None] * HALF
                at += [first + whole.argmax(1)] if full else []
                at += [begin + full * HALF + rest.argmax(0)[None]] if len(rest) else []
        return np.concatenate(top), np.concatenate(at) if places else None, x


def forward(halves: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """All steps from the halves' answers to the logit."""
    second = (halves[1:] > halves[:-1]) if len(halves) > 1 else np.zeros((1, halves.shape[1]), bool)
    best = np.maximum(halves[1:], halves[:-1]) if len(halves) > 1 else halves
    reading = np.maximum(best + p["bias"], 0)
    units = np.maximum(reading @ p["layer"] + p["layer_bias"], 0)
    text = np.concatenate((units.max(0), units.mean(0)))
    return {"second": second, "reading": reading, "units": units, "text": text, "logit": text @ p["out"] + p["out_bias"][0]}


def backward(f: dict[str, np.ndarray], at: np.ndarray, x: np.ndarray, slope: float, p: Params, g: Params) -> None:
    """Adds to ``g`` the gradient of a text, ``slope`` being that of its logit."""
    g["out"] += slope * f["text"]
    g["out_bias"] += slope
    chunks, back = len(f["units"]), slope * p["out"]
    d = np.repeat(back[None, UNITS:] / chunks, chunks, axis=0)
    d[f["units"].argmax(0), np.arange(UNITS)] += back[:UNITS]
    d *= f["units"] > 0
    g["layer"] += f["reading"].T @ d
    g["layer_bias"] += d.sum(0)
    d = (d @ p["layer"].T) * (f["reading"] > 0)
    g["bias"] += d.sum(0)
    chunk, filt = np.nonzero(d)
    place = at[chunk + f["second"][chunk, filt], filt]
    for w in range(WIDTH):
        np.add.at(g["filters"][w], (x[place + w], filt), d[chunk, filt])


def learnt(rows: list[tuple[int, bytes | None]], epochs: int = EPOCHS, seed: int = 12) -> Params:
    """Parameters fitted by Adam to the rows (label, text), in steps of 32 shuffled texts."""
    p, rng = start(seed), np.random.default_rng(seed + 1)
    share = min(max(np.mean([y for y, _ in rows]), 0.01), 0.99)
    p["out_bias"][:] = np.log(share / (1 - share))
    m, v = ({k: np.zeros(s, np.float32) for k, s in SHAPES.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(rows) // STEP)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(rows), STEP):
            some = order[begin : begin + STEP]
            tables, g = Filters(p["filters"]), {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
            for i in some:
                y, text = rows[i]
                halves, at, x = tables.halves(text, True)
                f = forward(halves, p)
                slope = 1 / (1 + np.exp(-np.clip(f["logit"], -35, 35))) - y
                backward(f, at, x, float(slope) / len(some), p, g)
            rate, step = RATE * (1 - step / steps), step + 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """o, y, text of the labelled rows that a fit may use (see TRAIN_ROWS), as a table."""
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("y"))
    share = min(1.0, TRAIN_ROWS / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit("quality"), "_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    return written(rows.select(F.xxhash64("_key").alias("o"), (F.col("y") > 0).cast("int").alias("y"), "text"), "bytecnn-sample")


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Params | None:
    """The network fitted to ``training_rows`` by one task, in an order given by a hash; none without labelled rows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("y").to_pylist(), raw_bytes(b.column("text")), strict=True)]
        if rows:
            p = learnt(rows)
            yield pa.RecordBatch.from_arrays([pa.array([p[k].astype("<f4").tobytes()], pa.binary()) for k in SHAPES], names=list(SHAPES))

    sample = training_rows(docs, labels, key=key, text=text, label=label)
    told = sample.repartition(1).sortWithinPartitions("o", "text").mapInArrow(learn, ", ".join(f"{k} binary" for k in SHAPES)).collect()
    return {k: np.frombuffer(told[0][k], "<f4").reshape(s) for k, s in SHAPES.items()} if told else None


def score_quality(docs: DataFrame, model: Params | None, *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``score``, the chance of label 1.

    ``columns`` names those of ``docs`` to return (all by default); a column ``score`` is replaced.
    """
    keep = [c for c in (columns or docs.columns) if c != "score"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        tables = p and Filters(p["filters"])
        for batch in texts_in(batches):
            logits = [float(forward(tables.halves(raw)[0], p)["logit"]) if p else 0.0 for raw in raw_bytes(batch.column(text))]
            score = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return docs.select(*{*keep, text}).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op12's contract: learns from labels outside the held-out fold only. A null key is in no fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit_quality(docs, labels.where(~held))
    told = score_quality(docs, model, columns=["doc_id"])
    return told.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
