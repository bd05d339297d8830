"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Every run of ``size`` words of a test item is a seed. A fixed-size bitmap of the seeds (its size doesn't depend on the
benchmark) is sent to the tasks and only thins out what is shuffled; the seeds themselves are joined. Passages around
hits are kept as word hashes, so texts are read once and never shuffled. A rare seed opens an alignment at once. A seed
that is frequent in the corpus opens one too, but first the words that passage and item have in common are counted:
a score needs as many matches as that share of the item's words, so no pair that could reach it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, NO_ID, Words, all_words, cut, flat, small, words

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the bitmap, pairs of passages and items that are aligned side by side.
BITS, AT_ONCE = 23, 256
_INSIDE = LETTERS.copy()
_INSIDE[0x30:0x3A] = True


def _gram_bits(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams >> np.uint64(64 - BITS)).astype(np.int64), ((grams >> np.uint64(17)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _items(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "_text"):
            w = words(*flat(batch["_text"]), True, _INSIDE)
            rows = []
            for k, item in enumerate(batch["_id"].to_pylist()):
                own = w.hash[w.first[k] : w.first[k + 1]]
                n = min(size, len(own))
                if n:
                    grams = words_grams(own, n)
                    ones, twos = _gram_bits(grams)
                    rows.append((item, own.view(np.int64), n, grams.view(np.int64), np.concatenate([ones, twos])))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["item_id", "item", "size", "grams", "bits"])

    return read


def words_grams(own: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words of one text."""
    return Words(own, own, own, np.array([0, len(own)])).grams(n)[1]


def _passages(shared, sizes: list[int], reach: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in small(batches, "_text"):
            w = all_words(batch["_text"], True, _INSIDE)
            hits = []
            for n in sizes:
                at, grams = w.grams(n)
                one, two = _gram_bits(grams)
                found = bitmap[one] & bitmap[two]
                hits.append((at[found], grams[found]))
            at, grams = (np.concatenate(x) for x in zip(*hits))
            order = np.argsort(at, kind="stable")
            at, grams = at[order], grams[order]
            of = w.text_of()[at]
            apart = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(of) > 0)) + 1
            ids = batch["_id"].to_pylist()
            rows = []
            for a, b in zip(np.append(0, apart), np.append(apart, len(at))) if len(at) else ():
                k = of[a]
                start, end = max(w.first[k], at[a] - reach), min(w.first[k + 1], at[b - 1] + reach + max(sizes))
                rows.append((ids[k], int(start - w.first[k]), w.hash[start:end].view(np.int64), at[a:b] - w.first[k], grams[a:b].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["id", "start", "words", "places", "grams"])

    return read


def smith_waterman(passages: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local score of each pair, and where in the passage the alignment begins and ends. All pairs run side by side."""
    n, rows, columns = len(items), max(map(len, items)), max(map(len, passages))
    p, q = np.zeros((n, columns), np.uint64), np.zeros((n, rows), np.uint64)
    real, real_item = np.zeros((n, columns), bool), np.zeros((n, rows), bool)
    for k, (x, y) in enumerate(zip(passages, items)):
        p[k, : len(x)], real[k, : len(x)] = x, True
        q[k, : len(y)], real_item[k, : len(y)] = y, True
    score, begin = np.zeros((n, columns + 1), np.int32), np.tile(np.arange(columns + 1), (n, 1))
    best, best_begin, best_end = (np.zeros(n, np.int64) for _ in range(3))
    place = np.arange(columns + 1)
    for i in range(rows):
        same = (p == q[:, i : i + 1]) & real & real_item[:, i : i + 1]
        new = np.zeros_like(score)
        new[:, 1:] = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        origin = np.empty_like(begin)
        origin[:, 0], origin[:, 1:] = 0, begin[:, :-1]
        down = score + GAP
        better = down > new
        new, origin = np.where(better, down, new), np.where(better, begin, origin)
        low = new <= 0
        new[low], origin[low] = 0, np.broadcast_to(place, origin.shape)[low]
        # gaps in the passage: the best of what stands to the left, less a gap for each step
        level = new - GAP * place
        top = np.maximum.accumulate(level, 1)
        source = np.maximum.accumulate(np.where(level == top, place, 0), 1)
        across = top + GAP * place
        better = across > new
        new, origin = np.where(better, across, new), np.where(better, np.take_along_axis(origin, source, 1), origin)
        score, begin = new.astype(np.int32), origin
        end = score.argmax(1)
        top = score[np.arange(n), end]
        more = top > best
        best[more], best_end[more], best_begin[more] = top[more], end[more], begin[np.arange(n), end][more]
    return list(zip(best.tolist(), best_begin.tolist(), best_end.tolist()))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a in range(0, len(batch), AT_ONCE):
            part = batch.slice(a, AT_ONCE)
            passages = [np.array(x, np.int64).view(np.uint64) for x in part["passage"].to_pylist()]
            items = [np.array(x, np.int64).view(np.uint64) for x in part["item"].to_pylist()]
            order = sorted(range(len(items)), key=lambda k: len(passages[k]) * len(items[k]))
            at = 0
            while at < len(order):  # pairs of like size together
                to, cells = at + 1, len(passages[order[at]]) * len(items[order[at]])
                while to < len(order) and len(passages[order[to]]) * len(items[order[to]]) <= 2 * cells + 2000:
                    to += 1
                some = order[at:to]
                found += [(a + k, *x) for k, x in zip(some, smith_waterman([passages[k] for k in some], [items[k] for k in some]))]
                at = to
        found.sort()
        _, score, begin, end = zip(*found) if found else ((), (), (), ())
        offset = batch["offset"].to_numpy()
        length = np.array([len(x) for x in batch["item"]], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["item_id"], pa.array(offset + np.array(begin, np.int64)), pa.array(offset + np.array(end, np.int64)), pa.array(np.array(score, float) / (MATCH * length))],
            names=["id", "item_id", "start", "end", "score"],
        )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", size: int = 3, least: float = 0.5, rare_share: float = 0.001, rare_docs: int = 20,
) -> DataFrame:
    """``(doc_id, item_id, start, end, score)``: passages that hold a test item, whole or edited; the best for each pair.

    Words are runs of letters and digits in lower case. ``score`` is the Smith-Waterman score (match 2, mismatch and gap
    -1) as a share of the item's score with itself; pairs from ``least`` on are returned, ``start`` and ``end`` count
    words of the document. A seed is rare when at most ``rare_docs`` passages or the share ``rare_share`` of all rows
    hold it; frequent ones find the same passages at less cost. An item of fewer words than ``size`` is one seed. Missing or empty texts and items have no passage; rows
    with a missing id count as one document with a missing id; repeated rows and items with equal texts are reported
    alike. Other columns aren't read.
    """
    spark = docs.sparkSession
    no_id = F.lit(NO_ID).cast("long")
    tests = benchmark.select(F.col(item_col).cast("long").alias("_id"), F.lower(F.col(item_text).cast("string")).alias("_text"))
    items = cut(tests.mapInArrow(_items(size), "item_id long, item array<long>, size int, grams array<long>, bits array<long>").distinct())
    shape = items.agg(F.collect_set("size"), F.max(F.size("item"))).first()  # one to ``size`` values
    empty = "id long, item_id long, start long, end long, score double"
    if not shape[0]:
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col)
    slots = items.select(F.explode("bits").alias("bit")).groupBy(F.expr("bit DIV 32").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("mask"))
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    for r in slots.collect():  # at most 2 ** (BITS - 5) rows
        bitmap[r["slot"]] = r["mask"]
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("_id"), F.lower(F.col(text_col).cast("string")).alias("_text"))
    reach = int(shape[1]) + int(shape[1]) // 2 + 8
    passages = cut(texts.mapInArrow(_passages(shared, sorted(shape[0]), reach), "id long, start long, words array<long>, places array<long>, grams array<long>"))
    hits = passages.select("id", "start", F.explode(F.arrays_zip("places", "grams")).alias("h")).select("id", "start", F.col("h.places").alias("place"), F.col("h.grams").alias("gram"))
    seeds = items.select("item_id", F.size("item").alias("n"), F.posexplode("grams").alias("item_place", "gram"))
    met = cut(hits.join(seeds, "gram"))
    bound = max(rare_docs, int(rare_share * docs.count()))
    rare = met.select("id", "start", "gram").distinct().groupBy("gram").agg((F.count("*") <= bound).alias("rare"))
    # passages that begin within one item's length of each other share a window
    met = met.join(rare, "gram").withColumn("window", F.floor((F.col("place") - F.col("item_place")) / F.col("n")))
    open_pairs = met.groupBy("id", "start", "item_id", "n", "window").agg(F.max("rare").alias("rare"))
    slack = F.floor(F.col("n") / 4) + 8
    first = F.greatest(F.lit(0), F.col("window") * F.col("n") - slack - F.col("start"))
    ready = open_pairs.join(passages.select("id", "start", "words"), ["id", "start"]).join(items.select("item_id", "item"), "item_id")
    ready = ready.withColumn("from", first.cast("int")).withColumn("offset", F.col("start") + F.col("from"))
    ready = ready.withColumn("passage", F.slice("words", F.col("from") + 1, (2 * F.col("n") + 2 * slack).cast("int")))
    common = F.size(F.filter("item", lambda x: F.array_contains("passage", x)))
    ready = ready.where(F.col("rare") | (common >= least * F.col("n"))).select("id", "item_id", "offset", "passage", "item")
    scored = ready.mapInArrow(_aligned, empty).where(F.col("score") >= least)
    best = scored.groupBy("id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), F.col("end").alias("e"))).alias("m"))
    return best.select(F.when(F.col("id") != no_id, F.col("id")).alias(id_col), "item_id", (-F.col("m.s")).alias("start"), F.col("m.e").alias("end"), F.col("m.score").alias("score"))
