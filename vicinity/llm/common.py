"""Shared by the operators: reading, scratch tables, and a vectorised reader of words."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch_dir

__all__ = ["cut", "scratch_dir"]

#: Stands for a missing id where ids are compared: a row without id sorts before all others.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Drops references to finished jobs, so that Spark's cleaner can delete their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, n: int, distinct: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder in ``n`` buckets of ``key``; later groupings and joins on it don't shuffle it.

    With ``distinct`` (columns that hold ``key``), one row of each is kept, which needs no further shuffle.
    """
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key)
    if distinct:
        dealt = dealt.dropDuplicates(distinct)
    writer = dealt.write.format("parquet").option("compression", "zstd").bucketBy(n, key)
    writer.option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    release(spark)
    return spark.table(name)


def learn_rows(id_col: str = "doc_id") -> Column:
    """True for documents from which labels may be learnt; false for held-out ones."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- words of Arrow text columns -------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[0x41:0x5B] = _VALUE[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base ("up") or of its inverse ("down"), modulo 2**64."""
    if len(_powers[kind]) < n:
        factors = np.full(1 << (n - 1).bit_length(), _BASE if kind == "up" else _INVERSE)
        factors[0] = 1
        _powers[kind] = np.multiply.accumulate(factors)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Letters: those of ASCII, and all bytes of longer characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """Words of several texts, one after the other. ``first[k]:first[k + 1]`` are those of text ``k``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word and 64-bit hash of every run of ``n`` words within one text."""
        if len(self.hash) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        m = len(self.hash)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(self.hash * _power("up", m), out=sums[1:])
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(m) + n <= last)
        return at, mix((sums[at + n] - sums[at]) * _power("down", m)[at])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a missing text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "") if column.null_count else column
    wide = column.type in (pa.large_string(), pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    k, n = 0, len(offsets) - 1
    while k < n:
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, min(to, n)
        k = min(to, n)


def small(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, which bounds what a task holds at once."""
    for batch in batches:
        _, offsets = flat(batch[column])
        for a, b in pieces(offsets, most):
            yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, inside: np.ndarray = ~_SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, with hashes; ``fold``: A-Z count as a-z. ``inside``: the bytes of words."""
    n = len(data)
    if not n:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    word = inside[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = word[edges]
    stop[edges - 1] = word[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUE)[data] * _power("up", n), out=sums[1:])
    return Words(start, end, mix((sums[end] - sums[start]) * _power("down", n)[start]), np.searchsorted(start, offsets))


def beginnings(data: np.ndarray, w: Words, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of words, A-Z as a-z; 0 for words that aren't longer."""
    out = np.zeros(len(w.hash), np.uint64)
    long = np.flatnonzero(w.end - w.start > size)
    value = np.zeros(len(long), np.uint64)
    for k in range(size):
        value = value * _BASE + _FOLDED[data[w.start[long] + k]]
    out[long] = mix(value + np.uint64(size))
    return out


def all_words(column: pa.Array | pa.ChunkedArray, fold: bool = False, inside: np.ndarray = ~_SPACE) -> Words:
    """Words of a whole column; positions are those in its bytes. Memory is bounded by reading a few MB at a time."""
    data, offsets = flat(column)
    parts, before = [], 0
    for a, b in pieces(offsets):
        w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold, inside)
        parts.append((w.start + offsets[a], w.end + offsets[a], w.hash, w.first[:-1] + before))
        before += len(w.hash)
    if not parts:
        return words(data, offsets, fold, inside)
    start, end, hashes, first = (np.concatenate(x) for x in zip(*parts))
    return Words(start, end, hashes, np.append(first, before))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts together."""
    return int(df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def shares(total: int, each: int, least: int) -> int:
    """A number of shares that follows the size of the data."""
    return max(least, math.ceil(total / each))
