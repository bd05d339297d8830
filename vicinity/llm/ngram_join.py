"""N-gram Jaccard join through a count-vector R-tree.

A document is the set of its word shingles. Shingles hash into groups, and the counts of its groups are the document's
point. The overlap of two sets is at most the sum of the smaller coordinates of their points, so points far apart
can't be similar.

*Index.* A plain R-tree over all coordinates prunes nothing here: boxes around random texts overlap in every
coordinate. So the tree is laid out by subspaces. Its first level are bands of set sizes, its second level blocks of
coordinates. Sets of similarity t and sizes up to s differ in at most s * (1 - t) / t =: D shingles, which touch as many
blocks; with more blocks than that, two similar sets agree in all coordinates of some block. There the box of a leaf is
a point, and a search is an equi-join on (band, block, counts). Blocks without shingles say nothing; they are left out
where enough others must agree.

*Two passes.* D + 1 blocks and a few more show which sets can have a partner at all: as many leaves as there are more
blocks must be shared. These leaves travel as packed arrays, one entry for each leaf of a batch. Only those sets get a finer tree of up to four times as many blocks, of which a set needs its D + 1 rarest: two sets that agree in all but D of their blocks share
one of these. So sets at the rim of a large group of copies, which have many blocks of their own, don't meet it.

*Pairs.* A leaf is not expanded into its pairs. Its most connected member is compared with the others first. After
every round all links so far are merged into components, and a leaf whose members left are of one component is done. In
the next rounds a few members of each leaf, drawn by a hash, eight times as many each time, are compared with those of
other components, and leave the leaf: all their pairs in it are settled then. So every pair of a leaf is compared or
already connected in the end, and the members of a group of copies are compared with a few of it, not with each other.
A pair must not differ in too many rarer blocks, nor in the parity of too many coordinates (each stands for a shingle
that only one of them has), and must pass the bound of summed minima over ``POINT`` coordinates; then the exact sets are
compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import merge_labels
from .common import NO_ID, all_words, bucketed, cut, mix, partitions, release, small, text_bytes
from .common import shares as number_of

#: Coordinates of a block (as bits), coordinates for the bound of a pair, ratio of sizes in a band.
GROUP_BITS, POINT, BAND = 20, 256, 1.35
#: Blocks of the finer tree for each one that may differ, at most.
FINER = 4
_ODD = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]


def _sets(texts: pa.ChunkedArray | pa.Array, size: int, fold: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    w = all_words(texts, fold)
    at, grams = w.grams(size)
    first = np.searchsorted(at, w.first)
    for k in range(len(w.first) - 1):
        a, b = first[k], first[k + 1]
        if b > a:
            own = np.sort(grams[a:b])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif (own := w.hash[w.first[k] : w.first[k + 1]]).size:
            total = np.uint64(len(own))
            for h in own:
                total = mix(total * _ODD[0] + h)
            yield np.array([total], np.uint64)
        else:
            yield own


def _band_top(k: int) -> int:
    """The largest size in band ``k``."""
    return math.ceil(BAND ** (k + 1)) - 1


def _band(n: int) -> int:
    k = max(0, int(math.log(n, BAND)) - 1)
    while _band_top(k) < n:
        k += 1
    return k


def _leaves(own: np.ndarray, k: int, blocks: int, spare: int) -> tuple[np.ndarray, int]:
    """Keys of a set's leaves in band ``k``, without those of empty blocks if at most ``spare`` are empty.

    With the number of them that a similar set must share: ``spare + 1`` blocks agree, some of which may have gone, here
    or, where this set lists its empty blocks, up to ``spare`` at a partner that doesn't list them.
    """
    block = ((own >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    edge = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(mix((own & np.uint64((1 << GROUP_BITS) - 1)) * _ODD[0] + _ODD[1]), out=sums[1:])
    n = np.diff(edge)
    number = np.arange(blocks, dtype=np.uint64)
    keys = mix(sums[edge[1:]] - sums[edge[:-1]] + n.astype(np.uint64) * _ODD[0] + number * _ODD[1] + np.uint64(k) * _ODD[2])
    empty = int((n == 0).sum())
    return (keys[n > 0], spare + 1 - empty) if empty <= spare else (keys, 1)


def _roles(percent: int) -> int:
    """A set's own band, and those below it in which the smaller of two similar sets can be."""
    return 2 if percent >= 75 else 2 + math.ceil(math.log(100 / percent, BAND))


def _searched(own: np.ndarray, percent: int, finer: int) -> list[tuple[np.ndarray, int]]:
    """Leaves where a set meets all that may be similar: in its band, and as the larger one in those below."""
    n, k = len(own), _band(len(own))
    found = [(np.empty(0, np.int64), 1)] * _roles(percent)
    for which, band in enumerate(range(k, k - len(found), -1)):
        if which == 0 or band >= 0 and percent * n <= 100 * _band_top(band):
            differing = _band_top(band) * (100 - percent) // percent
            spare = 0 if finer > 1 else 1 + differing // 4
            keys, needed = _leaves(own, band, finer * (differing + 1) + spare, spare)
            found[which] = keys.view(np.int64), needed
    return found


def _signs(size: int, fold: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")  # hashes wrap around
        for batch in small(batches, "_text"):
            rows = []
            for own in _sets(batch["_text"], size, fold):
                signs = own.sum(dtype=np.uint64), mix(own ^ _ODD[1]).sum(dtype=np.uint64)
                rows.append((len(own), *(int(x.astype(np.int64)) for x in signs)))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch["_id"], *(pa.array(x, pa.int64()) for x in columns)], names=["id", "n", "s1", "s2"])

    return read


def _counted(ids: np.ndarray, roles: np.ndarray, needed: np.ndarray, leaves: np.ndarray, shares: int) -> Iterator[tuple[int, bytes]]:
    """Share of the ids and packed counts: what a set needs, and how many shared leaves were found."""
    share = (mix(ids.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    edge = np.searchsorted(share[order], np.arange(shares + 1))
    for k in range(shares):
        own = order[edge[k] : edge[k + 1]]
        if len(own):
            yield k, b"".join(x[own].astype(t).tobytes() for x, t in zip((ids, roles, needed, leaves), ("<i8", "<i4", "<i4", "<i8")))


def _able(sent: pa.Table) -> pa.Table:
    """The ids of a share that found as many leaves as they need in one of their roles."""
    parts = []
    for payload in sent["payload"].to_pylist():
        n = len(payload) // 24
        parts.append([np.frombuffer(payload, t, n, at * n) for t, at in (("<i8", 0), ("<i4", 8), ("<i4", 12), ("<i8", 16))])
    ids, roles, needed, leaves = map(np.concatenate, zip(*parts))
    order = np.lexsort((roles, ids))
    ids, roles = ids[order], roles[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (roles[1:] != roles[:-1])))
    enough = np.add.reduceat(leaves[order], first) >= np.maximum(1, np.maximum.reduceat(needed[order], first))
    return pa.table({"id": np.unique(ids[first][enough])})


def _searches(size: int, fold: bool, percent: int, buckets: int):
    """Rows of a negative bucket: what each set of a batch needs and how many leaves it shares within the batch.

    Other rows: each leaf of the batch once, with one of its sets.
    """

    roles = _roles(percent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in small(batches, "_text", 4 << 20):
            found = [x for own in _sets(batch["_text"], size, fold) for x in (_searched(own, percent, 1) if len(own) else [(np.empty(0, np.int64), 1)] * roles)]
            ids = np.repeat(batch["_id"].to_numpy(), roles)
            number = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            leaf = np.concatenate([x for x, _ in found]).view(np.uint64)
            order = np.argsort(leaf, kind="stable")
            leaf, number = leaf[order], number[order]
            new = np.append(True, leaf[1:] != leaf[:-1])[: len(leaf)]
            alone = new & np.append(new[1:], True)[: len(leaf)]
            here = np.bincount(number[~alone], minlength=len(found))
            counts = _counted(ids, np.arange(len(ids)) % roles, np.array([n for _, n in found]), here, buckets)
            rows = [(-1 - k, payload) for k, payload in counts]
            leaf, number = leaf[new], number[new]
            bucket = ((leaf >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
            order = np.lexsort((number, bucket))
            bucket, leaf, number = bucket[order], leaf[order], number[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                own, of = leaf[edge[k] : edge[k + 1]], number[edge[k] : edge[k + 1]]
                if len(own):
                    parts = (own & np.uint64(0xFFFFFFFF)).astype("<u4"), ((own >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2"), ids[of].astype("<i8"), (of % roles).astype(np.int8)
                    rows.append((k, b"".join(x.tobytes() for x in parts)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["bucket", "payload"])

    return read


def _meet(buckets: int):
    def count(sent: pa.Table) -> pa.Table:
        """How many leaves of a bucket each set shares; rows of a negative bucket are such counts already."""
        if (bucket := sent["bucket"][0].as_py()) < 0:
            return pa.table([pa.array([-1 - bucket] * len(sent), pa.int32()), sent["payload"]], names=["share", "payload"])
        keys, ids, roles = [], [], []
        for payload in sent["payload"].to_pylist():
            n = len(payload) // 15
            keys.append(np.frombuffer(payload, "<u4", n).astype(np.uint64) | (np.frombuffer(payload, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)))
            ids.append(np.frombuffer(payload, "<i8", n, 6 * n))
            roles.append(np.frombuffer(payload, np.int8, n, 14 * n))
        key, own, role = np.concatenate(keys), np.concatenate(ids), np.concatenate(roles)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        alone = new & np.append(new[1:], True)
        met = order[~alone]
        met = met[np.lexsort((role[met], own[met]))]
        own, role = own[met], role[met]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (role[1:] != role[:-1]))[: len(own)])
        rows = list(_counted(own[first], role[first], np.zeros(len(first)), np.diff(np.append(first, len(own))), buckets))
        return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["share", "payload"])

    return count


def _whole(size: int, fold: bool, percent: int):
    finer = max(2, min(FINER, percent // (2 * (100 - percent) or 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in small(batches, "_text"):
            rows = []
            for own in _sets(batch["_text"], size, fold):
                point = np.bincount(((own >> np.uint64(8)) % np.uint64(POINT)).astype(np.int64), minlength=POINT)
                sign = int(own.sum(dtype=np.uint64).astype(np.int64))
                odd = np.packbits((point & 1).astype(bool), bitorder="little").view("<i8")
                rows.append((len(own), sign, point.astype(np.int32), odd, own.view(np.int64), [x for x, _ in _searched(own, percent, finer)]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
            columns = list(zip(*rows)) if rows else [()] * 6
            names = ["id", "n", "s1", "point", "odd", "own", "leaves"]
            yield pa.RecordBatch.from_arrays([batch["_id"], *(pa.array(x, t) for x, t in zip(columns, kinds))], names=names)

    return read


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar: first by the bound over points, then by the sets themselves."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    least = f"{100 + percent} * {{}} >= {percent} * (na + nb)"
    near = cut(
        pairs.join(side("a"), "a").join(side("b"), "b").where(least.format("least(na, nb)"))
        .where(least.format("aggregate(zip_with(pa, pb, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"))
        .select("a", "b", "na", "nb")
    )
    both = near.join(sets.select(F.col("id").alias("a"), F.col("own").alias("oa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("own").alias("ob")), "b"
    )
    return cut(both.where(least.format("size(array_intersect(oa, ob))")).select("a", "b").distinct())


def _ranked_members(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, n, leaf, members, degree, e0 .. e3, o0 .. o3)``: the leaves in which a set is searched, which rarer blocks
    differ, and which coordinates are odd.

    At the rarest leaf that two sets share, all rarer blocks of both differ; too many of them rule the pair out there.
    """
    entries = sets.select("id", "n", "s1", F.explode(F.expr("flatten(transform(leaves, (l, r) -> transform(l, (x, i) -> struct(r AS role, i AS block, x AS leaf))))")).alias("e"))
    entries = entries.select("id", "n", "s1", "e.role", "e.block", "e.leaf")
    often = entries.groupBy("leaf").agg(F.count("*").alias("members"))
    own = Window.partitionBy("id", "s1", "role")
    order = own.orderBy("members", "leaf")
    bit = "CASE WHEN pmod(block, 256) DIV 64 = {0} THEN shiftleft(1L, block % 64) ELSE 0L END"
    earlier = [F.coalesce(F.bit_or(F.expr(bit.format(k))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"e{k}") for k in range(4)]
    ranked = entries.join(often, "leaf").select(
        "id", "s1", "n", "leaf", "members", F.row_number().over(order).alias("place"), F.sum("members").over(own).alias("degree"), *earlier
    )
    few = ranked.where(F.expr(f"members > 1 AND place <= n * {100 - percent} DIV {percent} + 1")).drop("place")
    odd = sets.select("id", "s1", *(F.col("odd")[k].alias(f"o{k}") for k in range(4)))
    return cut(few.join(odd, ["id", "s1"]).drop("s1"))


#: Members of a leaf that are compared in a round, for each one of the round before.
FANOUT = 8
#: The round in which a member of a leaf is compared with the rest: a few of them in the first, then ever more.
_ROUND = f"greatest(1, cast(ceil(log({FANOUT}, (pmod(xxhash64(id, 7), 1048576) + 1) / 1048576D * members)) AS int))"


def _links(ranked: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Components ``(node, root)`` of the sets that link, or None if none do."""
    differing = " + ".join(f"bit_count(e{k} | f{k})" for k in range(4))
    apart = " + ".join(f"bit_count(o{k} ^ g{k})" for k in range(4))
    most = f"(n + m) * {100 - percent} DIV {100 + percent}"
    possible = F.expr(f"{differing} <= {most} AND {apart} <= {most} AND {100 + percent} * least(n, m) >= {percent} * (n + m)")
    bits = [F.col(f"{own}{k}").alias(f"{other}{k}") for own, other in (("e", "f"), ("o", "g")) for k in range(4)]
    members, known, turn = ranked.withColumn("turn", F.expr(_ROUND)), None, 0
    while True:
        if turn == 0:  # every set is on its own, and the members are written already
            labelled = members.withColumn("comp", F.col("id"))
        elif known is None:
            labelled = cut(members.withColumn("comp", F.col("id")))
        else:
            named = members.join(known, members["id"] == known["node"], "left")
            labelled = cut(named.withColumn("comp", F.coalesce("root", "id")).drop("node", "root"))
        parts = labelled.groupBy("leaf", "comp").agg(F.max(F.struct("degree", "id", F.col("n").alias("m"), *bits)).alias("top"))
        leaves = cut(parts.groupBy("leaf").agg(F.max("top").alias("top"), F.count("*").alias("comps")).where("comps > 1"))
        if leaves.isEmpty():
            return known
        live = labelled.join(leaves.select("leaf"), "leaf", "left_semi")
        if turn == 0:
            tops = leaves.select("leaf", F.col("top.id").alias("other"), F.col("top.id").alias("other_comp"), "top.m", *(f"top.{x}{k}" for x in "fg" for k in range(4)))
        else:
            tops = live.where(F.col("turn") == turn).select("leaf", F.col("id").alias("other"), F.col("comp").alias("other_comp"), F.col("n").alias("m"), *bits)
        met = live.join(tops, (live["leaf"] == tops["leaf"]) & F.expr("comp <> other_comp") & possible)
        pairs = cut(met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        found = _linked(pairs, sets, percent)
        if not found.isEmpty():
            links = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
            if known is not None:
                links = links.unionByName(known.select(F.col("node").alias("u"), F.col("root").alias("v")))
            known = merge_labels(links)
        if turn == 0:
            settled = leaves.select("leaf", "top.id", F.col("top.m").alias("n"), *(F.col(f"top.{x}{k}").alias(f"{own}{k}") for own, x in (("e", "f"), ("o", "g")) for k in range(4)))
            members = live.drop("comp").join(settled, settled.columns, "left_anti")
        else:
            members = live.where(F.col("turn") > turn).drop("comp")
        release(ranked.sparkSession)
        turn += 1


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, fold: bool = True,
) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)``: components of documents that link by the Jaccard of their shingles.

    Words are ``[^\\x20\\x09-\\x0D]+``, with A-Z as a-z when ``fold``. A set holds the distinct runs of ``size`` words; a
    shorter text is one shingle, a text without words (or none) has no set and no link. Two documents link when
    ``100 * intersection >= percent * union``. ``class_id`` is the smallest id with an equal set, ``component_id`` the
    smallest id that links lead to. Rows that share an id are one document with all their links; a missing id is one
    as well and sorts first (its class is missing then). Other columns aren't read; an empty table gives an empty one.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    shares = partitions(spark)
    no_id = F.lit(NO_ID).cast("long")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    base = cut(texts.mapInArrow(_signs(size, fold), "id long, n long, s1 long, s2 long"))
    classes = cut(base.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    total = text_bytes(texts, "_text")
    sent = texts.mapInArrow(_searches(size, fold, percent, parts := number_of(total, 16 << 20, shares)), "bucket int, payload binary")
    counts = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_meet(parts), "share int, payload binary")
    able = counts.groupBy("share").applyInArrow(_able, "id long")
    able = cut(able.join(classes.select(F.col("rep").alias("id")), "id", "left_semi"))
    release(spark)
    sets = texts.join(able.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    kinds = "id long, n long, s1 long, point array<int>, odd array<long>, own array<long>, leaves array<array<long>>"
    sets = bucketed(sets.mapInArrow(_whole(size, fold, percent), kinds), "id", shares, distinct=["id", "s1"])
    ranked = _ranked_members(sets, percent)
    release(spark)
    known = _links(ranked, sets, percent)
    result = base.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    if known is not None:
        result = result.join(known, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("root", "rep"))
    else:
        result = result.withColumn("component", F.col("rep"))
    real = lambda c: F.when(F.col(c) != no_id, F.col(c))
    return result.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("rep").alias("class_id"), real("component").alias("component_id"))
