"""Conversation prefix trie: what conversations share from their first turn on.

Turns are encoded by a dictionary, equal conversations become one row with the list of its members hashed. The rows are
dealt into ranges of their id sequences. Each range is a ternary search tree: a node holds one turn id and has links to
smaller ids, to larger ids and to the next turn. Sequences are inserted from the median outwards, which balances the
tree. An iterative traversal numbers the nodes, and going back through it adds members, leaves and savings to parents.

A prefix that more than one range holds lies on the first or last path of its range. Only these boundary nodes are sent
on: equal ones are merged by the hash of their path, and sums over their subtrees are made by doubling distances (after
round r a node has the sum over all descendants less than 2**r below), so deep paths take few rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, shares

#: Turns of a range, members whose ids are joined at once (as bits of the id).
RANGE, CHUNK_BITS = 1 << 17, 12
_WORD = r"[^\x20\x09-\x0D]+"
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turns array<struct<key, words>>)``: the turns of each conversation in order (a missing turn number first).

    ``key`` stands for role and text (128 bits; a missing one is empty), ``words`` counts words of the text. Equal turn
    numbers are ordered by ``key``. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.md5(role), text)))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("t"))
    listed = rows.where("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.expr("transform(t, x -> struct(x.key AS key, x.words AS words))").alias("turns"))


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first ``h`` turns come from the first of their family of ``family`` ids; ``h`` is crc32 mod ``most``.

    A conversation without rows in the input isn't rebuilt. Where the family's first one is absent or shorter, fewer turns
    are taken over; a conversation that had no more than ``h`` turns has only those.
    """
    first = convs.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    all_ = convs.withColumn("base", F.col("conv") - F.col("conv") % family).join(first, "base", "left").withColumn("h", h)
    none = F.expr("slice(turns, 1, 0)")
    return all_.select("conv", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of sequence and chunk: one for each sequence, with its members' ids hashed as they pass by."""
    seq, digest, n, first, turns = None, None, 0, 0, None

    def done():
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return [pa.array([x], kind) for x, kind in zip((seq, n, first, digest.hexdigest()), kinds)] + [turns]

    for batch in batches:
        out = []
        for k, (key, many, least, ids) in enumerate(zip(*(batch[c].to_pylist() for c in ("seq", "n", "first", "ids")))):
            if key != seq:
                if seq is not None:
                    out.append(done())
                seq, digest, n, first, turns = key, hashlib.sha256(ids.encode()), many, least, batch["turns"].slice(k, 1)
            else:
                digest.update(b"," + ids.encode())
                n, first = n + many, min(first, least)
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], names=["seq", "n", "first", "ends", "turns"])
    if seq is not None:
        yield pa.RecordBatch.from_arrays(done(), names=["seq", "n", "first", "ends", "turns"])


def _distinct(convs: DataFrame) -> DataFrame:
    """``(seq, n, first, ends, turns)``: equal conversations as one, with the hash of their ids in ascending order.

    Ids are joined in chunks of neighbouring ids, which any task may do; only the finished chunks of a sequence pass
    through one task, one after the other, because a hash needs them in order.
    """
    kind = dict(convs.dtypes)["turns"]
    rows = convs.withColumn("seq", F.unhex(F.expr("md5(array_join(transform(turns, x -> hex(x.key)), ''))")))
    chunk = rows.groupBy("seq", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.count("*").alias("n"), F.min("conv").alias("first"), F.array_sort(F.collect_list("conv")).alias("ids"), F.first("turns").alias("turns")
    )
    chunk = chunk.withColumn("ids", F.expr("array_join(transform(ids, x -> cast(x AS string)), ',')"))
    dealt = chunk.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "n", "first", "ids", "turns")
    return cut(dealt.mapInArrow(_hashed, f"seq binary, n long, first long, ends string, turns {kind}"))


def _encoded(seqs: DataFrame) -> tuple[DataFrame, int]:
    """Sequences of dictionary ids, and how many turns they have together."""
    turns = seqs.select("seq", F.posexplode("turns").alias("pos", "t")).select("seq", "pos", "t.key", "t.words")
    known = cut(turns.select("key").distinct().withColumn("id", F.monotonically_increasing_id()))
    coded = turns.join(known, "key").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("t"))
    coded = coded.select("seq", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))
    nothing = F.array().cast("array<long>")
    out = cut(seqs.drop("turns").join(coded, "seq", "left").select("n", "first", "ends", F.coalesce("ids", nothing).alias("ids"), F.coalesce("words", nothing).alias("words")))
    return out, int(out.agg(F.sum(F.size("ids") + 1)).first()[0] or 0)


class Tree:
    """A ternary search tree over sequences of ids. Node 0 is the empty prefix; of the others, ``smaller``, ``larger`` and
    ``following`` are links (0: none)."""

    def __init__(self) -> None:
        self.id, self.smaller, self.larger, self.following, self.words, self.row = [0], [0], [0], [0], [0], [-1]

    def _new(self, one: int, words: int) -> int:
        for column, value in zip((self.id, self.smaller, self.larger, self.following, self.words, self.row), (one, 0, 0, 0, words, -1)):
            column.append(value)
        return len(self.id) - 1

    def insert(self, ids: list[int], words: list[int], row: int) -> None:
        at = 0
        for one, many in zip(ids, words):
            links, node = self.following, at
            while child := links[node]:
                if one == self.id[child]:
                    break
                links, node = (self.smaller if one < self.id[child] else self.larger), child
            else:
                child = links[node] = self._new(one, many)
            at = child
        self.row[at] = row

    def order(self) -> Iterator[tuple[int, int, int]]:
        """Every node with its parent and depth, parents first."""
        yield 0, -1, 0
        open_ones = [(self.following[0], 0, 1)] if self.following[0] else []
        while open_ones:
            node, parent, depth = open_ones.pop()
            yield node, parent, depth
            for other, above, level in ((self.smaller[node], parent, depth), (self.larger[node], parent, depth), (self.following[node], node, depth + 1)):
                if other:
                    open_ones.append((other, above, level))


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    open_ones = [(0, n)]
    while open_ones:
        a, b = open_ones.pop()
        if a < b:
            yield (a + b) // 2
            open_ones += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]


_NODE = {
    "key": "binary", "parent": "binary", "conv": "long", "depth": "long", "parent_conv": "long", "n": "long", "children": "long",
    "leaves": "long", "saved": "long", "words": "long", "ends": "string",
}


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range. Those of its first and last path have a ``key`` and sums without each other's."""
    rows = [r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("ids", "words", "n", "first", "ends")))]
    if not rows:
        return
    tree = Tree()
    for k in median_first(len(rows)):
        tree.insert(rows[k][0], rows[k][1], k)
    size = len(tree.id)
    order = list(tree.order())
    parent, depth, conv, n, children, leaves, saved = ([0] * size for _ in range(7))
    for node, above, level in order:
        parent[node], depth[node] = above, level
        if (row := tree.row[node]) >= 0:
            n[node], conv[node] = rows[row][2], rows[row][3]
        else:
            conv[node] = None
    key: list[bytes | None] = [None] * size
    key[0] = b""
    paths = {}
    for k in (0, len(rows) - 1):
        at = b""
        for one in rows[k][0]:
            at = hashlib.md5(at + one.to_bytes(8, "big", signed=True)).digest()
            paths[at] = one
    for node, above, _ in order[1:]:
        if key[above] is not None:
            own = hashlib.md5(key[above] + tree.id[node].to_bytes(8, "big", signed=True)).digest()
            key[node] = own if own in paths else None
    for node, above, _ in reversed(order):
        whole = key[node] is None
        if whole:
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * tree.words[node]
        if above >= 0:
            n[above] += n[node]
            conv[above] = conv[node] if conv[above] is None else min(conv[above], conv[node])
            if whole:
                children[above] += 1
                leaves[above] += leaves[node]
                saved[above] += saved[node]
    out = []
    for node, above, level in order:
        own = None if above < 0 else key[above]
        shown = conv[above] if above >= 0 and own is None else None
        row = tree.row[node]
        out.append((key[node], own, conv[node], level, shown, n[node], children[node], leaves[node], saved[node], tree.words[node], rows[row][4] if row >= 0 else None))
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    for a in range(0, len(out), 1 << 14):
        columns = zip(*out[a : a + (1 << 14)])
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, kind in zip(columns, _NODE.values())], names=list(_NODE))


def _merged(boundary: DataFrame) -> DataFrame:
    """Boundary nodes with equal paths as one, with the sums of their whole subtrees."""
    one = cut(
        boundary.groupBy("key").agg(
            F.first("parent").alias("parent"), F.min("conv").alias("conv"), F.first("depth").alias("depth"),
            *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.max("words").alias("words"), F.max("ends").alias("ends"),
        )
    )
    below = one.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    one = cut(one.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more"))
    sums = one.select(
        "key", F.col("parent").alias("up"), (F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("saved"),
    )
    deepest, reach = one.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        more = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = sums.select(F.col("key").alias("up"), F.col("up").alias("next"))
        sums = cut(
            sums.join(more, "key", "left").join(further, "up", "left").select(
                "key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
            )
        )
        reach *= 2
    return cut(one.drop("leaves", "saved").join(sums.drop("up"), "key"))


def prefix_trie(convs: DataFrame, range_turns: int = RANGE) -> DataFrame:
    """A row for each distinct beginning of conversations (see ``conversations``), the empty one included.

    ``conv_id`` is its smallest member, ``parent_conv_id`` that of the beginning without the last turn, ``n_convs`` counts
    members, ``n_children`` the next turns, ``n_leaves`` and ``saved_tokens`` (members but one, times words of the last
    turn) go over the whole subtree, ``ends_sha256`` hashes the ids of conversations that end here. A conversation
    without turns is a member of the empty beginning alone. No conversation gives no row.
    """
    spark = convs.sparkSession
    coded, turns = _encoded(_distinct(cut(convs)))
    ranges = shares(turns, range_turns, partitions(spark))
    dealt = coded.repartitionByRange(ranges, "ids").sortWithinPartitions("ids")
    nodes = cut(dealt.mapInArrow(_range_nodes, ", ".join(f"{c} {kind}" for c, kind in _NODE.items())))
    boundary = _merged(nodes.where("key IS NOT NULL"))
    inner = nodes.where("key IS NULL").drop("key")
    above = boundary.select(F.col("key").alias("parent"), F.col("conv").alias("known"))
    columns = [
        F.col("conv").alias("conv_id"), "depth", F.coalesce("known", "parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(_NO_MEMBERS)).alias("ends_sha256"),
    ]
    rest = boundary.withColumn("parent_conv", F.lit(None).cast("long")).select(*inner.columns)
    return inner.unionByName(rest).join(above, "parent", "left").select(*columns)
