"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a window of bytes in both directions, labels every position, and a document's probabilities are the
mean of its positions'. A fit sees windows from a bounded sample of documents; a prediction reads the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, learn_rows, small

#: Units in each direction, bytes of a window, windows in a step of a prediction.
UNITS, SPAN, AT_ONCE = 8, 64, 2048
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
for _b in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_b] = _b
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z (and the capitals of Latin-1 likewise), all else of ASCII as spaces."""
    out = _FOLD[data]
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[latin] += 0x20
    return out


class Network:
    """``h' = (1 - z) * n + z * h`` in both directions, and a softmax over both states at every position."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, c = UNITS, len(labels)
        self.labels = labels
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"u{way}"] = rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
            self.p[f"c{way}"] = np.zeros(h, np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, c)).astype(np.float32)
        self.p["d"] = np.zeros(c, np.float32)

    def _run(self, x: np.ndarray, way: str, keep: bool):
        """States of one direction, position by position; ``x`` is (positions, windows)."""
        h, inputs, u, c = UNITS, self.p[f"x{way}"], self.p[f"u{way}"], self.p[f"c{way}"]
        state = np.zeros((x.shape[1], h), np.float32)
        states, trace = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a = inputs[x[t]]
            b = state @ u
            gates = a[:, : 2 * h] + b[:, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            r, z = gates[:, :h], gates[:, h:]
            m = b[:, 2 * h :] + c
            n = np.tanh(a[:, 2 * h :] + r * m)
            if keep:
                trace.append((t, state, r, z, m, n))
            state = n + z * (state - n)
            states[t] = state
        return states, trace

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (positions, windows, labels)."""
        ahead, back = self._run(x, "f", False)[0], self._run(x, "b", False)[0]
        o = self.p["o"]
        y = ahead.reshape(-1, UNITS) @ o[:UNITS]
        y += back.reshape(-1, UNITS) @ o[UNITS:]
        y += self.p["d"]
        np.exp(y, out=y)  # states lie in (-1, 1) and weights are small: no overflow
        y /= y.sum(1, keepdims=True)
        return y.reshape(*x.shape, -1)

    def _gradient(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        (ahead, trace_f), (back, trace_b) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate([ahead, back], 2)
        y = both @ self.p["o"] + self.p["d"]
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        y[:, np.arange(x.shape[1]), label] -= 1
        y *= (weight / (weight.sum() * len(x))).astype(np.float32)[None, :, None]
        g["o"] = np.einsum("twi,twc->ic", both, y)
        g["d"] = y.sum((0, 1))
        into = y @ self.p["o"].T
        h = UNITS
        for way, trace, own in (("f", trace_f, into[:, :, :h]), ("b", trace_b, into[:, :, h:])):
            u, carry = self.p[f"u{way}"], np.zeros((x.shape[1], h), np.float32)
            for t, before, r, z, m, n in reversed(trace):
                carry = carry + own[t]
                dn = carry * (1 - z) * (1 - n * n)
                dz = carry * (before - n) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                da = np.concatenate([dr, dz, dn], 1)
                db = np.concatenate([dr, dz, dn * r], 1)
                np.add.at(g[f"x{way}"], x[t], da)
                g[f"u{way}"] += before.T @ db
                g[f"c{way}"] += (dn * r).sum(0)
                carry = carry * z + db @ u.T
        return g

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int = 400, size: int = 192, rate: float = 0.02, seed: int = 11) -> None:
        """Backpropagation through time with Adam. Labels weigh alike, however many windows each has."""
        rng = np.random.default_rng(seed)
        share = np.bincount(label, minlength=len(self.labels))
        weight = (1.0 / np.maximum(share, 1))[label]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            some = rng.integers(0, len(label), size)
            g = self._gradient(x[some].T, label[some], weight[some])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 500, windows: int = 8) -> Network | None:
    """A network learnt from at most ``per_label`` documents of each language, ``windows`` short pieces of each.

    Pieces start at pseudo-random places of the whole text. Only rows that ``learn_rows`` allows are used.
    """
    rows = docs.where(learn_rows(id_col)).where(F.col(lang_col).isNotNull() & (F.char_length(text_col) > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    places = [F.substr(F.col(text_col), (1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(F.char_length(text_col) - SPAN, F.lit(1)))).cast("int"), F.lit(SPAN)) for k in range(windows)]
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.array(*places).alias("pieces"))
    found = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_label).collect()
    found.sort(key=lambda r: (r["lang"], r["at"]))
    labels = sorted({r["lang"] for r in found})
    if not labels:
        return None
    x, label = [], []
    for r in found:
        for piece in r["pieces"]:
            raw = folded(np.frombuffer(piece.encode(), np.uint8))[:SPAN]
            if (raw != 0x20).any():
                x.append(np.pad(raw, (0, SPAN - len(raw)), constant_values=0x20))
                label.append(labels.index(r["lang"]))
    network = Network(labels)
    if x:
        network.fit(np.array(x), np.array(label))
    return network


def _mean(network: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over letter positions, for each text: probabilities, and how often each label was the likeliest."""
    lengths = np.diff(offsets)
    n = -(-lengths // SPAN)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[text] + nth * SPAN
    have = np.minimum(SPAN, offsets[text + 1] - start)
    sums = np.zeros((len(n), len(network.labels)))
    labelled = np.zeros_like(sums)
    padded = np.concatenate([folded(data), np.full(SPAN, 0x20, np.uint8)])
    step = np.arange(SPAN)[:, None]
    for a in range(0, len(text), AT_ONCE):
        own = slice(a, a + AT_ONCE)
        x = np.where(step < have[own], padded[start[own] + step], 0x20)
        y = network.positions(x)
        letters = x != 0x20
        likeliest = y.argmax(2)
        for k in range(y.shape[2]):
            sums[:, k] += np.bincount(text[own], (y[:, :, k] * letters).sum(0), len(n))
            labelled[:, k] += np.bincount(text[own], ((likeliest == k) & letters).sum(0), len(n))
    return sums, labelled


def _predict(network: Network | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "_text"):
            best, score, share = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            if network is not None:
                sums, labelled = _mean(network, *flat(batch["_text"]))
                total = sums.sum(1)
                top = sums.argmax(1)
                lettered = np.array(batch["_lettered"].to_pylist(), bool) & (total > 0)
                best = [network.labels[k] if ok else UNKNOWN for k, ok in zip(top, lettered)]
                score = np.where(lettered, sums.max(1) / np.maximum(total, 1e-9), 0.0)
                share = np.where(lettered, labelled[np.arange(len(top)), top] / np.maximum(labelled.sum(1), 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(share)], names=["_id", "lang_pred", "score", "labelled_share"])

    return read


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, labelled_share)`` for every row, from the whole text alone.

    ``score`` is the document's probability of the language, ``labelled_share`` the share of positions that were
    labelled with it. A missing text, or one without a letter, is ``und`` with score 0, as is every text when no
    language could be learnt. Rows that repeat an id are judged each; other columns aren't read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.withColumn("_lettered", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(_predict(network), f"_id {kind}, lang_pred string, score double, labelled_share double").withColumnRenamed("_id", id_col)
