"""Quality rules on repetition, by suffix arrays over words.

The suffixes of a batch's texts are sorted by prefix doubling: ranks of runs of 1, 2, 4, ... words, where only suffixes
that still tie are sorted again. The ranks of all rounds give the longest common prefix of neighbours, from the longest
run down. Neighbours with a common prefix of a length form an interval; an interval whose suffixes don't all follow the
same word is a maximal repeated substring. The deepest interval of a suffix is as long as the larger of its two common
prefixes, so the spans of all repeats are united without listing nested ones. The share of words that they cover and
the longest of them are limited. Texts are judged one by one: nothing is shuffled, a task holds a few MB of text at once
(or one text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, Words, all_words, flat, small

#: Words of the shortest repeat, percent of words that repeats may cover, words of the longest repeat.
LEAST, MAX_SHARE, MAX_REPEAT = 3, 40, 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.arange(256) != 0x0A


def suffix_array(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several texts in order (text by text), and the common prefix of each with the one before it.

    ``first[k]:first[k + 1]`` are the words of text ``k``; suffixes of different texts have nothing in common.
    """
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    order = np.lexsort((hashes, text))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1]))[:n]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds, length = [rank], 1
    while len(slots := np.flatnonzero(~(new & np.append(new[1:], True)[:n]))):
        at = order[slots]
        after = at + length
        inside = after < end[at]
        second = np.where(inside, rank[np.where(inside, after, 0)], -1)
        head = rank[at]
        by = np.lexsort((second, head))
        at, head, second = at[by], head[by], second[by]
        order[slots] = at
        fresh = np.append(True, (head[1:] != head[:-1]) | (second[1:] != second[:-1]))
        new[slots] = fresh
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rounds.append(rank)
        length *= 2
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(np.append(False, rounds[0][order][1:] == rounds[0][order][:-1])[:n])
    one, two, own = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        a, b = one + own, two + own
        inside = (a < end[one]) & (b < end[two])
        same = inside & (rounds[k][np.where(inside, a, 0)] == rounds[k][np.where(inside, b, 0)])
        own[same] += 1 << k
    common[pair] = own
    return order, common


def deepest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """At every word, the length of the longest repeat that begins there."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0)[: len(common)])
    return out


def united(depth: np.ndarray, least: int) -> np.ndarray:
    """True for every word inside a repeat of at least ``least`` words."""
    at = np.flatnonzero(depth >= least)
    edge = np.zeros(len(depth) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + depth[at], -1)
    return np.cumsum(edge[:-1]) > 0


def maximal_repeats(order: np.ndarray, common: np.ndarray, w: Words, least: int) -> list[tuple[int, int, int]]:
    """``(first start, length, times)`` of the maximal repeated substrings of at least ``least`` words."""
    n = len(order)
    before = np.where(np.isin(order, w.first), -1 - order, 0)
    real = before == 0
    known = np.unique(w.hash, return_inverse=True)[1]
    before[real] = known[order[real] - 1]
    changes = np.cumsum(np.append(0, before[1:] != before[:-1])) if n else before
    found, open_ones = [], []  # of an open interval: its length, its first slot
    for slot in np.flatnonzero((common >= least) | np.append(common[:-1] >= least, False)[:n] | np.append(False, common[:-1] >= least)[:n]).tolist() + [n]:
        now, begin = (int(common[slot]) if slot < n else 0), slot - 1
        while open_ones and open_ones[-1][0] > now:
            length, begin = open_ones.pop()
            if changes[slot - 1] > changes[begin]:
                found.append((int(order[begin:slot].min()), length, slot - begin))
        if now >= least and (not open_ones or open_ones[-1][0] < now):
            open_ones.append((now, begin))
    return found


def _lines(column: pa.Array, data: np.ndarray) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier one."""
    w = all_words(column, inside=_NOT_NEWLINE)
    filled = np.append(0, np.cumsum(~_SPACE[data]))
    real = filled[w.end] > filled[w.start]
    text, hashes = w.text_of()[real], w.hash[real]
    order = np.lexsort((hashes, text))
    again = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][again], minlength=len(column))


_KINDS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"
_REPEATS = ", repeats array<struct<start:long,length:long,times:long>>"


def _read(least: int, listed: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")  # hashes wrap around
        for batch in small(batches, "_text"):
            column = batch["_text"]
            data, offsets = flat(column)
            per_text = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
            w = all_words(column)
            order, common = suffix_array(w.hash, w.first)
            depth = deepest(order, common)
            covered = np.append(0, np.cumsum(united(depth, least)))
            longest = np.zeros(len(column), np.int64)
            np.maximum.at(longest, w.text_of(), depth)
            columns = [
                np.diff(w.first), per_text(((data & 0xC0) != 0x80) & ~_SPACE[data]), per_text(_SYMBOL[data]), _lines(column, data),
                np.diff(covered[w.first]), longest,
            ]
            arrays = [batch["_id"], *(pa.array(x, pa.int64()) for x in columns)]
            if listed:
                text, lists = w.text_of(), [[] for _ in range(len(column))]
                for start, length, times in maximal_repeats(order, common, w, least):
                    k = text[start]
                    lists[k].append({"start": start - int(w.first[k]), "length": length, "times": times})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("times", pa.int64())]))
                arrays.append(pa.array([sorted(x, key=lambda r: (r["start"], r["length"])) for x in lists], kind))
            names = [x.split()[0] for x in _KINDS.split(", ")] + ["repeats"] * listed
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return read


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, max_share: int = MAX_SHARE,
    max_repeat: int = MAX_REPEAT, min_words: int = 50, base_share: int = 50, list_repeats: bool = False,
) -> DataFrame:
    """A row for each row of ``docs``: counts of its text, ``base_failed`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` are words inside repeats of at least ``least`` words,
    ``longest_repeat`` the words of the longest repeat of any length (0: no word occurs twice; its copies may overlap).
    A text fails the base with fewer than ``min_words`` words or more than ``base_share`` percent of them in repeats; it
    is kept if it does not, repeats cover at most ``max_share`` percent and none is longer than ``max_repeat`` words.
    With ``list_repeats``, ``repeats`` are the maximal repeated substrings: first word, length, times.
    A missing or empty text has no words and fails. Rows are judged alone: a missing or repeated id changes nothing,
    other columns aren't read, an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    counts = texts.mapInArrow(_read(least, list_repeats), _KINDS + _REPEATS * list_repeats)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > base_share * F.col("n_words"))
    fits = (100 * F.col("n_repeat_words") <= max_share * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return counts.select(
        F.col("id").alias(id_col), *counts.columns[1:6], failed.alias("base_failed"), (~failed & fits).alias("kept"),
        *counts.columns[6:],
    )
