"""Substring dedup: repeated runs of words are found by fixed-block anchors and removed from all but their first place.

A run of ``window`` words holds at least one whole reference block of ``block`` words that starts at a multiple of
``block`` in its document, as long as ``window >= 2 * block - 1``. So two equal runs meet in the index: the earlier one
holds a reference block, and the later one has the same words at some rolling position.

1. *Anchors.* Documents are dealt into chunks (a bucketed table, so that later passes don't shuffle texts). A chunk
   sends the distinct hashes of its rolling windows of ``block`` words, marked when one of them is a reference block;
   a hash goes to its bucket once for each chunk, however often it occurs there. A bucket answers with the hashes
   that occur more than once and in the reference index.
2. *Extension.* Around hits, a chunk takes the windows of ``window`` words and sends each distinct one with its first
   place. A bucket finds the first place of all; every other place is a repeat.
3. *Maximal repeats.* Overlapping repeated windows of a document merge into maximal spans, and those words go.

Texts stay whole and all places are found: a frequent passage costs one entry for each chunk, not one for each pair.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, all_words, bucketed, cut, flat, partitions, release, shares, text_bytes

#: Bytes of text in a chunk, and in the chunks whose windows meet in one bucket.
CHUNK, BUCKET = 4 << 20, 12 << 20
_KEY = (1 << 38) - 1
_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])


def _ordered(docs: pa.Table) -> pa.Table:
    ids = pc.fill_null(docs["_id"], NO_ID)
    return docs.set_column(docs.schema.get_field_index("_id"), "_id", ids).sort_by([("_id", "ascending"), ("_text", "ascending")])


def _address(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and key of a hash; other bits go into the one than into the other."""
    return ((grams >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32), grams & np.uint64(_KEY)


def _message(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else ((), (), ()), _MESSAGE)], schema=_MESSAGE)


def _packed(values: np.ndarray) -> bytes:
    """40-bit values in two planes."""
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpacked(payload: bytes) -> np.ndarray:
    n = len(payload) // 5
    return np.frombuffer(payload, "<u4", n).astype(np.uint64) | (np.frombuffer(payload, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _slices(bucket: np.ndarray):
    """Runs of equal values."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])) if len(bucket) else ()


def _anchors(block: int, buckets: int):
    def send(docs: pa.Table) -> pa.Table:
        w = all_words(_ordered(docs)["_text"])
        at, grams = w.grams(block)
        chunk = docs["_chunk"][0].as_py()
        if not len(at):
            return _message([])
        aligned = (at - w.first[w.text_of()[at]]) % block == 0
        bucket, key = _address(grams, buckets)
        packed = (bucket.astype(np.uint64) << np.uint64(39)) | (key << np.uint64(1)) | aligned
        packed.sort()
        new = np.append(True, packed[1:] >> np.uint64(1) != packed[:-1] >> np.uint64(1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(packed)) - 1
        whole = packed[first] >> np.uint64(1)
        # two marks beside the key: more than one place in the chunk, and a reference block
        entry = ((whole & np.uint64(_KEY)) << np.uint64(2)) | ((last > first).astype(np.uint64) << np.uint64(1)) | (packed[last] & np.uint64(1))
        bucket = (whole >> np.uint64(38)).astype(np.int32)
        return _message([(int(bucket[a]), chunk, _packed(entry[a:b])) for a, b in _slices(bucket)])

    return send


def _hits(sent: pa.Table) -> pa.Table:
    """Which hashes of each chunk occur more than once, and once at least as a reference block."""
    parts = [_unpacked(x) for x in sent["payload"].to_pylist()]
    chunks = sent["chunk"].to_pylist()
    entry = np.concatenate(parts)
    order = np.argsort(entry >> np.uint64(2), kind="stable")
    key = (entry >> np.uint64(2))[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key)))
    marks = np.bitwise_or.reduceat((entry & np.uint64(3))[order], first)
    good = np.repeat(((n > 1) | (marks & np.uint64(2) > 0)) & (marks & np.uint64(1) > 0), n)
    chosen = np.zeros(len(entry), bool)
    chosen[order] = good
    bucket, rows, before = sent["bucket"][0].as_py(), [], 0
    for chunk, part in zip(chunks, parts):
        if (own := part[chosen[before : before + len(part)]]).size:
            rows.append((bucket, chunk, _packed(own >> np.uint64(2))))
        before += len(part)
    return _message(rows)


def _extend(window: int, block: int, buckets: int):
    def send(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(docs) or not len(hits):
            return _message([])
        docs = _ordered(docs)
        w = all_words(docs["_text"])
        chunk = docs["_chunk"][0].as_py()
        at, grams = w.grams(block)
        bucket, key = _address(grams, buckets)
        known = np.concatenate([_unpacked(p) | (np.uint64(b) << np.uint64(38)) for b, p in zip(hits["bucket"].to_pylist(), hits["payload"].to_pylist())])
        known.sort()
        own = key | (bucket.astype(np.uint64) << np.uint64(38))
        place = np.searchsorted(known, own)
        hit = np.zeros(len(w.hash) + 1, np.int64)
        hit[at + 1] = known[np.minimum(place, len(known) - 1)] == own
        sums = np.cumsum(hit)
        at, grams = w.grams(window)
        near = sums[at + window - block + 1] > sums[at]
        at, grams = at[near], grams[near]
        if not len(at):
            return _message([])
        order = np.argsort(grams, kind="stable")
        new = np.append(True, grams[order][1:] != grams[order][:-1])
        rows = [(-1, chunk, np.sort(at[order[~new]]).astype("<u4").tobytes())]  # repeats within the chunk
        at, grams = at[order[new]], grams[order[new]]
        bucket = ((grams >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        order = np.lexsort((at, bucket))
        bucket, at, grams = bucket[order], at[order], grams[order]
        text = w.text_of()[at]
        ids = docs["_id"].to_numpy()
        for a, b in _slices(bucket):
            of, n = np.unique(text[a:b], return_counts=True)
            head = np.array([len(of), b - a], "<u4").tobytes()
            rows.append((int(bucket[a]), chunk, head + ids[of].astype("<i8").tobytes() + w.first[of].astype("<u4").tobytes() + n.astype("<u4").tobytes() + grams[a:b].astype("<u8").tobytes() + at[a:b].astype("<u4").tobytes()))
        return _message(rows)

    return send


def _later(sent: pa.Table) -> pa.Table:
    """The windows of each chunk that start earlier somewhere else."""
    grams, ids, starts, places, chunks = [], [], [], [], []
    for chunk, payload in zip(sent["chunk"].to_pylist(), sent["payload"].to_pylist()):
        texts, n = np.frombuffer(payload, "<u4", 2).tolist()
        at, get = 8, lambda kind, size, count: np.frombuffer(payload, kind, count, at)
        doc, at = get("<i8", 8, texts), at + 8 * texts
        first, at = get("<u4", 4, texts), at + 4 * texts
        count, at = get("<u4", 4, texts), at + 4 * texts
        gram, at = get("<u8", 8, n), at + 8 * n
        place = get("<u4", 4, n)
        grams.append(gram)
        ids.append(np.repeat(doc, count))
        starts.append(place - np.repeat(first, count))
        places.append(place)
        chunks.append(np.full(n, chunk, np.int32))
    gram, doc, start, place, chunk = map(np.concatenate, (grams, ids, starts, places, chunks))
    order = np.lexsort((place, start, doc, gram))
    gram = gram[order]
    later = order[np.flatnonzero(np.append(False, gram[1:] == gram[:-1]))]
    chunk, place = chunk[later], place[later]
    order = np.lexsort((place, chunk))
    chunk, place = chunk[order], place[order]
    return _message([(-1, int(chunk[a]), place[a:b].astype("<u4").tobytes()) for a, b in _slices(chunk)])


_RESULT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _remove(window: int):
    def cover(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        if not len(docs):
            return _RESULT.empty_table()
        docs = _ordered(docs)
        w = all_words(docs["_text"])
        change = np.zeros(len(w.hash) + 1, np.int64)
        for payload in repeats["payload"].to_pylist():
            at = np.frombuffer(payload, "<u4")
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        kept = np.cumsum(change)[:-1] == 0
        data, offsets = flat(docs["_text"])
        raw = data.tobytes()
        rows = []
        for k, key in enumerate(docs["_id"].to_pylist()):
            a, b = w.first[k], w.first[k + 1]
            own = raw[offsets[k] : offsets[k + 1]].split()
            keep = kept[a:b]
            gone = int(len(keep) - keep.sum())
            spans = []
            if gone:
                own = itertools.compress(own, keep)
                edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]))).reshape(-1, 2)
                spans = [{"start": int(x), "end": int(y)} for x, y in edges]
            rows.append((None if key == NO_ID else key, int(b - a), gone, b" ".join(own).decode(), spans))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    return cover


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, spans)``: every document without the words of repeated windows.

    Words are ``[^\\x20\\x09-\\x0D]+``. A window of ``window`` words is a repeat when the same words also start in a
    document with a smaller id or earlier in the same document; windows are judged on the input. ``spans`` are the
    maximal runs of removed words, ``kept_text`` the other words joined by one space. A missing or empty text has no
    words; a missing id sorts before all ids; rows with equal ids are ordered by text, and of equal rows one is the
    earlier. An empty table gives an empty result, other columns of ``docs`` are not read, so their names can't clash.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    total = text_bytes(docs, "_text")
    chunks, buckets = shares(total, CHUNK, partitions(spark)), shares(total, BUCKET, partitions(spark))
    dealt = bucketed(docs.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int")), "_chunk", chunks)
    message = "bucket int, chunk int, payload binary"
    hits = cut(
        dealt.groupBy("_chunk").applyInArrow(_anchors(block, buckets), message)
        .groupBy("bucket").applyInArrow(_hits, message)
    )
    release(spark)
    sent = cut(dealt.groupBy("_chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(window, block, buckets), message))
    release(spark)
    later = cut(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_later, message))
    release(spark)
    repeats = sent.where("bucket < 0").unionByName(later)
    result = "_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"
    return (
        dealt.groupBy("_chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(window), result)
        .withColumnRenamed("_id", id_col)
    )
