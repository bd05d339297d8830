"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicon words, how near they are to second-person words, and rates of capitals, punctuation
and obfuscation. Besides a short fixed lexicon there is a learnt one: whole words and word beginnings that are much
more frequent in toxic documents. It is learnt from a bounded sample of labelled documents in folds, so that the trees
see the features of a document with a lexicon that didn't see it. Calibration uses margins of trees that didn't either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees
from .common import LETTERS, beginnings, flat, learn_rows, small, words

#: Bytes of the word beginnings in the lexicon, besides whole words.
BEGINNINGS = (4, 6)
#: Words near a second-person word, words in which density is looked at.
NEAR, LOCAL = 5, 40
#: Second-person words of the languages of the corpus, lower case.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "ti", "usted", "ustedes", "vosotros", "tus")
#: Common insults, lower case.
INSULTS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "imbecile", "jerk", "idiota", "estúpido", "estúpida", "imbécil", "tonto", "idiote", "stupide", "imbécile", "crétin", "dumm", "dummkopf", "blödmann", "trottel", "arschloch")
#: Parts of the sample, and the least log ratio of a learnt term.
FOLDS, LEAST_RATIO = 4, 1.6
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), True, LETTERS).hash


_YOU, _INSULTS = (np.sort(np.concatenate([_hashes(w) for w in x])) for x in (SECOND_PERSON, INSULTS))


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Runs of letters, and for each kind of term the hash of every word (0 where the word is too short)."""
    w = words(data, offsets, True, LETTERS)
    kinds = [w.hash, *(beginnings(data, w, k) for k in BEGINNINGS)]
    return w, kinds


def _held(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


#: Sorted hashes of the terms of a kind, and the log of how much more frequent each is in toxic documents.
Lexicon = list[tuple[np.ndarray, np.ndarray]]


def _dense(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The features of each text."""
    n = len(offsets) - 1
    w, kinds = _terms(data, offsets)
    of = w.text_of()
    n_words = np.diff(w.first).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / size

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    either, columns = _held(_INSULTS, w.hash), []
    found = np.bincount(of[either], minlength=n)
    columns += [np.log1p(found), found * per_word]
    weight = either * 3.0
    for (table, ratio), kind in zip(lexicon, kinds):
        hit = _held(table, kind) & (kind != 0)
        found = np.bincount(of[hit], minlength=n)
        columns += [np.log1p(found), found * per_word]
        weight[hit] = np.maximum(weight[hit], ratio[np.searchsorted(table, kind[hit])])
        either |= hit
    total = np.bincount(of, weight, n)
    columns += [np.log1p(total), total * per_word]
    at = np.flatnonzero(either)
    pair = np.unique(np.stack([of[at], w.hash[at].view(np.int64)], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
    columns.append(np.log1p(np.bincount(pair[:, 0], minlength=n)))
    window = np.concatenate([[0], np.cumsum(either)])
    local = np.zeros(n)
    if len(at):
        np.maximum.at(local, of[at], (window[np.minimum(at + LOCAL, w.first[of[at] + 1])] - window[at]).astype(float))
    columns.append(local)
    you = np.concatenate([[0], np.cumsum(_held(_YOU, w.hash))])
    near = you[np.minimum(at + NEAR + 1, w.first[of[at] + 1])] - you[np.maximum(at - NEAR, w.first[of[at]])] > 0
    columns += [np.bincount(of[at][near], minlength=n) * per_word, np.diff(you[w.first]) * per_word]
    upper = (data >= 0x41) & (data <= 0x5A)
    mark, digit, letter = _PUNCTUATION[data], _DIGIT[data], LETTERS[data]
    columns += [count(upper) * per_byte, count(mark) * per_byte, count(data == 0x21) * per_byte, count(digit) * per_byte]
    inner = np.zeros(len(data), bool)
    if len(data) > 2:  # a mark or digit between two letters
        inner[1:-1] = (mark[1:-1] | digit[1:-1]) & letter[:-2] & letter[2:]
    columns += [count(inner) * per_word, np.log1p(n_words), np.bincount(of, w.end - w.start, n) * per_word]
    return np.stack(columns, 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None
    prior: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.prior)
        return self.calibration(self.trees.margin(_dense(data, offsets, self.lexicon)))


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each kind of term and distinct term of a document."""
    for batch in small(batches, "_text", 1 << 20):
        w, kinds = _terms(*flat(batch["_text"]))
        of = w.text_of()
        for k, kind in enumerate(kinds):
            pair = np.unique(np.stack([of, kind.view(np.int64)], 1), axis=0)
            pair = pair[pair[:, 1] != 0]
            at = pa.array(pair[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), k, np.int32)), pa.array(pair[:, 1]), batch["_label"].take(at), batch["_fold"].take(at)], names=["kind", "term", "_label", "_fold"])


def _features(lexicons: list[Lexicon]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "_text", 1 << 20):
            fold = np.array(batch["_fold"].to_pylist(), np.int64)
            x = np.stack([_dense(*flat(batch["_text"]), own) for own in lexicons])[fold, np.arange(len(fold))]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_label"], batch["_fold"], pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_label", "_fold", "x"])

    return read


def _lexicon(terms: list, counts: dict[int, int], without: int | None) -> Lexicon:
    """The lexicon of all folds, or of all but one."""
    own = [k for k in range(FOLDS) if k != without]
    share = len(own) / FOLDS
    out = []
    for kind in range(1 + len(BEGINNINGS)):
        rows = [(r["term"], sum(r[f"t{k}"] for k in own), sum(r[f"c{k}"] for k in own)) for r in terms if r["kind"] == kind]
        term, toxic, clean = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        ratio = np.log((toxic + 0.5) / (counts[1] * share + 1)) - np.log((clean + 0.5) / (counts[0] * share + 1))
        good = (toxic >= max(2, 0.004 * counts[1])) & (ratio >= LEAST_RATIO)
        hashes = term[good].view(np.uint64)
        order = np.argsort(hashes)
        out.append((hashes[order], ratio[good][order]))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_label: int = 4000, most_terms: int = 4000,
) -> Model:
    """A model from at most ``per_label`` documents of each label, chosen by their ids' hash among those to learn from.

    The lexicon takes at most ``most_terms`` terms of each kind, those of most toxic documents first. Documents weigh
    as their label does among all labelled ones.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(learn_rows("_id"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if not counts.get(0) or not counts.get(1):
        return Model([], None, None, prior)
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
    chosen = known.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_label)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")  # at most 2 * per_label ids
    rows = rows.select("_id", "_text", "_label", (F.col("_at") % FOLDS).cast("int").alias("_fold"))
    in_fold = lambda c, k: F.sum(F.when(F.col("_fold") == k, c).otherwise(0))
    terms = rows.mapInArrow(_distinct_terms, "kind int, term long, _label int, _fold int").groupBy("kind", "term").agg(
        F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("clean"),
        *(in_fold(F.col("_label"), k).alias(f"t{k}") for k in range(FOLDS)), *(in_fold(1 - F.col("_label"), k).alias(f"c{k}") for k in range(FOLDS)),
    )
    counts = {k: min(v, per_label) for k, v in counts.items()}
    ratio = F.log((F.col("toxic") + 0.5) / (counts[1] + 1)) - F.log((F.col("clean") + 0.5) / (counts[0] + 1))
    best = Window.partitionBy("kind").orderBy(F.desc("toxic"), "term")
    terms = terms.where((F.col("toxic") >= 2) & (ratio >= LEAST_RATIO / 2)).withColumn("at", F.row_number().over(best)).where(F.col("at") <= most_terms).collect()
    lexicons = [_lexicon(terms, counts, k) for k in range(FOLDS)]
    seen = rows.mapInArrow(_features(lexicons), "_id long, _label int, _fold int, x array<double>").collect()
    seen.sort(key=lambda r: (r["_id"] is None, r["_id"], r["x"]))
    y = np.array([r["_label"] for r in seen], float)
    if len(set(y.tolist())) < 2:
        return Model([], None, None, prior)
    x = np.array([r["x"] for r in seen])
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    weight /= weight.mean()
    margin, part = np.zeros(len(y)), np.array([r["_fold"] for r in seen])
    for k in range(FOLDS):
        own = part == k
        if own.any() and len(set(y[~own].tolist())) == 2:
            margin[own] = Trees().fit(x[~own], y[~own], weight[~own]).margin(x[own])
    return Model(_lexicon(terms, counts, None), Trees().fit(x, y, weight), Isotonic().fit(margin, y, weight), prior)


def _score(model: Model):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "_text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(model.score(*flat(batch["_text"])), pa.float64())], names=["_id", "score"])

    return read


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row, from its whole text alone.

    A missing text scores like an empty one. Without labels of both kinds every score is the share of toxic labels
    (0 without labels). Rows that repeat an id are judged each; other columns aren't read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    scored = rows.mapInArrow(_score(model), f"_id {kind}, score double").withColumnRenamed("_id", id_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: Model, text: str, threshold: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text, 1 << 20):
            yield batch.filter(pa.array(model.score(*flat(batch[text])) < threshold))

    return read


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic; one pass without a join."""
    return docs.mapInArrow(_keep(model, text_col, threshold), docs.schema)
