"""Quality by naive Bayes support vectors over n-gram indicators.

An indicator says whether an n-gram occurs in a text: runs of bytes, and runs of word shapes (case, final mark, length,
digits, same word as before), hashed into a fixed number of columns. Every column is scaled by the log ratio of its
frequencies in the two classes, and a linear hinge-loss model on the scaled columns is fitted by dual coordinate
descent. A sigmoid fitted on documents that the model did not see turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import all_words, flat, learn_rows, mix, small

#: Columns (as bits), lengths of byte and shape n-grams.
BITS, BYTES, SHAPES = 17, (2, 3), (1, 2, 3)
_MIX = np.uint32(0x9E3779B1)
_LATIN_UPPER = np.zeros(256, bool)
_LATIN_UPPER[0x41:0x5B] = True
_LATIN_LOWER = np.zeros(256, bool)
_LATIN_LOWER[0x61:0x7B] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _shapes(data: np.ndarray, column: pa.Array):
    """A number for the shape of every word, and the words."""
    w = all_words(column)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    upper, lower, letter = sums(_LATIN_UPPER), sums(_LATIN_LOWER), sums(_LETTER)
    up, low = upper[w.end] - upper[w.start], lower[w.end] - lower[w.start]
    size = w.end - w.start
    case = np.where(low == 0, np.where(up > 1, 3, 0), np.where(up == 0, 1, 2))
    marks = size - (letter[w.end] - letter[w.start])
    tail = np.where(_LETTER[data[w.end - 1]], 0, data[w.end - 1]) if len(size) else np.empty(0, np.int64)
    again = np.zeros(len(size), np.int64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    length = np.searchsorted([2, 4, 7, 11, 18], size)
    shape = ((((case * 128 + (tail & 127)) * 2 + again) * 8 + length) * 4 + np.minimum(marks, 3)).astype(np.uint64)
    return w, mix(shape + np.uint64(1))


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct columns of each text's n-grams."""
    data, offsets = flat(column)
    shift = np.uint32(32 - BITS)
    runs = []
    for n in BYTES:
        code = np.full(max(0, len(data) - n + 1), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + data[k : len(data) - n + 1 + k]
        runs.append((n, (code * _MIX) >> shift))
    w, shape = _shapes(data, column)
    shapes = []
    for n in SHAPES:
        code = np.full(max(0, len(shape) - n + 1), n, np.uint64)
        for k in range(n):
            code = mix(code * np.uint64(31) + shape[k : len(shape) - n + 1 + k])
        shapes.append((n, (code >> np.uint64(64 - BITS)).astype(np.uint32)))
    seen = np.zeros(1 << BITS, bool)
    for k in range(len(offsets) - 1):
        a, b, first, last = offsets[k], offsets[k + 1], w.first[k], w.first[k + 1]
        parts = [code[a : max(a, b - n + 1)] for n, code in runs] + [code[first : max(first, last - n + 1)] for n, code in shapes]
        whole = np.concatenate(parts)
        if len(whole) > 1 << 14:
            seen[whole] = True
            own = np.flatnonzero(seen).astype(np.uint32)
            seen[own] = False
        else:
            own = np.sort(whole)
            own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        yield own


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weight[columns].sum() / max(1.0, np.sqrt(len(columns))) + self.bias)

    def score(self, column: pa.Array) -> list[float]:
        margins = np.array([self.margin(x) for x in indicators(column)])
        return (1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))).tolist()


def log_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of how much likelier each column is in class 1 than in class 0."""
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for own, label in zip(rows, y):
        counts[int(label)][own] += 1
    share = [c / (n + 2 * alpha) for c, n in zip(counts, (np.sum(y == 0), np.sum(y == 1)))]
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights (on unscaled indicators) and bias of the linear hinge-loss model over scaled indicators.

    Each step solves one document's dual variable exactly, clipped to its box ``[0, cost]``. Indicators of a document
    are divided by the root of their number.
    """
    rng = np.random.default_rng(seed)
    sign, dual = np.where(y == 1, 1.0, -1.0), np.zeros(len(y))
    weight, bias = np.zeros(1 << BITS), 0.0
    part = [scale[own] / max(1.0, np.sqrt(len(own))) for own in rows]
    square = np.array([float(x @ x) + 1.0 for x in part])
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            slack = 1.0 - sign[k] * (weight[rows[k]] @ part[k] + bias)
            new = min(max(dual[k] + slack / square[k], 0.0), cost[k])
            if (step := (new - dual[k]) * sign[k]):
                weight[rows[k]] += step * part[k]
                bias += step
                dual[k] = new
    return weight * scale, bias


def _sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets a little inside of 0 and 1."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -40, 40)))
        g = x.T @ (weight * (p - target)) + np.array([1e-3 * (slope - 1), 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(slope, 1e-3), offset


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in small(batches, "_text"):
        own = [x.astype("<u4").tobytes() for x in indicators(batch["_text"])]
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["_label"], pa.array(own, pa.binary())], names=["_id", "_label", "columns"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 2500, cost: float = 1.0) -> Model:
    """A model from at most ``per_label`` documents of each label, chosen by their ids' hash among those to learn from.

    One row in four fits the sigmoid and not the support vectors. Rows weigh as their label does among all labelled.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(learn_rows("_id"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    flat_model = Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not counts.get(0) or not counts.get(1):
        return flat_model
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
    chosen = known.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_label).select("_id", "_label")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")  # at most 2 * per_label ids
    seen = rows.mapInArrow(_gathered, "_id long, _label int, columns binary").collect()
    seen.sort(key=lambda r: (r["_id"] is None, r["_id"], bytes(r["columns"])))
    columns, y = [np.frombuffer(r["columns"], "<u4") for r in seen], np.array([r["_label"] for r in seen])
    own = np.arange(len(y)) % 4 > 0
    if min((y[own] == 0).sum(), (y[own] == 1).sum(), (y[~own] == 0).sum(), (y[~own] == 1).sum()) == 0:
        return flat_model
    train = [columns[k] for k in np.flatnonzero(own)]
    scale = log_ratios(train, y[own])
    mass = np.where(y == 1, prior / (y == 1).mean(), (1 - prior) / (y == 0).mean())
    weight, bias = dual_descent(train, y[own], scale, cost * np.ones(own.sum()))
    model = Model(weight, bias, 1.0, 0.0)
    model.slope, model.offset = _sigmoid(np.array([model.margin(columns[k]) for k in np.flatnonzero(~own)]), y[~own], mass[~own])
    return model


def _score(shared):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        model = shared.value
        for batch in small(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(model.score(batch["_text"]), pa.float64())], names=["_id", "score"])

    return read


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row, from its whole text alone.

    A missing text scores like an empty one. Without labels of both kinds every score is the share of good labels
    (a half without labels). Rows that repeat an id are judged each; other columns aren't read. What is sent to the
    tasks is the model: two to the power of ``BITS`` weights.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    scored = rows.mapInArrow(_score(shared), f"_id {kind}, score double").withColumnRenamed("_id", id_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
