"""Ranked lexical search by NRA: lists sorted by impact, read in sequence, with score intervals for every document.

*Index.* A batch of documents is a shard: for every term of the items, the documents of the shard that hold it and how
often. Shards are written once, nothing is shuffled. The counts of the whole corpus (documents, terms, documents of each
term) are sums over shards; only they and the items go to the tasks, in blocks of bounded size.

*Search.* With the counts known, a list of a shard is put in the order of its impacts. For an item, the lists of its
terms are read from the top, a block of each at a time and no entry at random. What was read of a document is its lower
bound; together with the next unread impact of the lists it wasn't seen in, that is its upper bound. Reading ends when
no unseen document can reach the k-th best lower bound, and every document that still can has no gap between its bounds:
then members, ties and scores are final. A task carries the best documents of an item from shard to shard, so that later
shards end sooner, often at once; it returns k of each item, and a window takes the k best of those.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTERS, NO_ID, all_words, cut, flat, small, words

#: Bytes of text in a shard, bytes of items in a block, entries that the first round reads of a list.
SHARD, BLOCK, FIRST = 8 << 20, 8 << 20, 32
_INSIDE = LETTERS.copy()
_INSIDE[0x30:0x3A] = True


def _shards(shared):
    """A row for each shard: counts, ids and lengths of documents that hold a term, and entries by term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")  # hashes wrap around
        terms = np.frombuffer(shared.value, np.uint64)
        for batch in small(batches, "_text", SHARD):
            w = all_words(batch["_text"], True, _INSIDE)
            n = np.diff(w.first)
            place = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
            hit = np.flatnonzero(terms[place] == w.hash)
            own, at = np.unique(w.text_of()[hit], return_inverse=True)
            entry, often = np.unique(place[hit] * np.int64(max(1, len(own))) + at, return_counts=True)
            term, doc = np.divmod(entry, max(1, len(own)))
            held, df = np.unique(term, return_counts=True)
            row = {
                "docs": int((n > 0).sum()), "length": int(n.sum()), "terms": held, "df": df,
                "ids": batch["_id"].to_numpy()[own].astype("<i8").tobytes(), "n": n[own].astype("<i8").tobytes(),
                "doc": doc.astype("<u4").tobytes(), "tf": often.astype("<u4").tobytes(),
            }
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *(pa.binary(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row.values(), kinds)], names=list(row))

    return read


_SHARD_KIND = "docs long, length long, terms array<long>, df array<long>, ids binary, n binary, doc binary, tf binary"


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = end - begin
    return np.arange(n.sum()) + np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n)


def nra(begin: np.ndarray, end: np.ndarray, doc: np.ndarray, gain: np.ndarray, n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that are among the ``k`` best or tie with them, and their scores.

    ``begin[i]:end[i]`` is a list: entries of ``doc`` and ``gain``, greatest gain first. ``least`` is a score that ``k``
    documents elsewhere have reached (0: none); what stays below it is left out.
    """
    lists = len(begin)
    lower, seen = np.zeros(n_docs, np.int64), np.zeros((lists, n_docs), bool)
    at, block, number = begin.copy(), FIRST, np.arange(lists)
    while True:
        left = at < end
        ahead = np.where(left, gain[np.minimum(at, len(gain) - 1)], 0)
        total = int(ahead.sum())
        bound = max(least, int(np.partition(lower, n_docs - k)[n_docs - k])) if n_docs >= k else least
        if total < bound or total == 0:
            able = np.flatnonzero((lower > 0) & (lower >= bound - total))
            gap = ahead @ ~seen[:, able]
            able, gap = able[lower[able] + gap >= max(bound, 1)], gap[lower[able] + gap >= max(bound, 1)]
            if not gap.any():
                return able, lower[able]
        to = np.minimum(at + block, end)
        entries = _ranges(at, to)
        docs = doc[entries]
        seen[np.repeat(number, to - at), docs] = True
        lower += np.bincount(docs, gain[entries], n_docs).astype(np.int64)  # sums below 2**53 are exact
        at, block = to, 2 * block


def _search(shared, k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, unit, items = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]  # heaps of score and negative id
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["n"], "<i8")
                if not len(ids):
                    continue
                doc, tf = (np.frombuffer(row[x], "<u4").astype(np.int64) for x in ("doc", "tf"))
                held, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
                term = np.repeat(np.arange(len(held)), df)
                size = 75 + 25 * n * unit[0] // unit[1]
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * size[doc])
                order = np.lexsort((-impact, term))
                doc, impact = doc[order], impact[order]
                edge = np.append(0, np.cumsum(df))
                for item, (terms, times) in enumerate(items):
                    where = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                    real = (held[where] == terms) & (weight[terms] > 0)
                    where, factor = where[real], (weight[terms] * times)[real]
                    if not len(where):
                        continue
                    top = best[item]
                    least = top[0][0] if len(top) == k else 0
                    if least > int((impact[edge[where]] * factor).sum()):
                        continue
                    count = df[where]
                    entries = _ranges(edge[where], edge[where + 1])
                    begin = np.append(0, np.cumsum(count))
                    found, score = nra(begin[:-1], begin[1:], doc[entries], impact[entries] * np.repeat(factor, count), len(ids), k, least)
                    for one, value in zip(ids[found].tolist(), score.tolist()):
                        if len(top) < k:
                            heapq.heappush(top, (value, -one))
                        else:
                            heapq.heappushpop(top, (value, -one))
        rows = [(item, -one, value) for item, top in enumerate(best) for value, one in top]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item", "id", "score"])

    return read


def _item_terms(texts: pa.Array) -> list[Counter]:
    np.seterr(over="ignore")
    w = words(*flat(texts), True, _INSIDE)
    return [Counter(w.hash[a:b].tolist()) for a, b in zip(w.first[:-1], w.first[1:])]


def _ranked_block(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """``(item, id, score)`` for one block of items; ``item`` is the row in the block."""
    spark = docs.sparkSession
    terms = _item_terms(items["_text"])
    known = np.array(sorted({t for own in terms for t in own}), np.uint64)
    if not len(known):
        return spark.createDataFrame([], "item long, id long, score long")
    shards = cut(docs.mapInArrow(_shards(spark.sparkContext.broadcast(known.tobytes())), _SHARD_KIND))
    n, length = shards.agg(F.sum("docs"), F.sum("length")).first()
    entries = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select("e.*")
    counts = entries.groupBy("terms").agg(F.sum("df").alias("df")).toArrow()  # at most the terms of a block
    df = np.zeros(len(known), np.int64)
    df[counts["terms"].to_numpy()] = counts["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * (n or 0) + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = []
    for own in terms:
        hashes = np.array(sorted(own), np.uint64)
        asked.append((np.searchsorted(known, hashes), np.array([own[h] for h in hashes.tolist()], np.int64)))
    shared = spark.sparkContext.broadcast((weight, (n or 0, length or 1), asked))
    return shards.mapInArrow(_search(shared, k), "item long, id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z. A document's score sums,
    over the item's terms with repeats, ``w * (1000000000 * tf div (1000 * tf + 12 * m))`` with
    ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 75 + 25 * n * N div L`` over all documents with a term.
    Only scores above 0 are returned. Missing and empty texts have no term. Every row of ``docs`` is a document and every
    row of ``items`` an item of its own, also where ids repeat or are missing (a missing id sorts first). Other columns
    aren't read; an empty table gives an empty one. Items are taken in blocks of about ``block_bytes``, each against all
    documents: a block is what goes through the driver and to the tasks.
    """
    spark = docs.sparkSession
    no_id = F.lit(NO_ID).cast("long")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    own = items.select(F.col(item_col).alias("_item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("_text"))
    own = cut(own.withColumn("_row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil((own.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0) / block_bytes))
    found = None
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == block).toArrow()
        named = spark.createDataFrame(part.select(["_row", "_item"]).append_column("item", pa.array(range(len(part)), pa.int64())))
        rows = _ranked_block(docs, part, k).join(named, "item")
        found = rows if found is None else found.unionByName(rows)
    best = Window.partitionBy("_row").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != no_id, F.col("id")).alias(id_col), "score"
    )
