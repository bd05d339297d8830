"""Extendible hashing on DataFrames: buckets named by the leading bits of a hash, split only where they are too full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of a text, as a non-negative long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int | Column) -> Column:
    shift = F.lit(BITS) - depth
    return F.call_function("shiftrightunsigned", h, shift.cast("int"))


def bucket_name(h: Column, depth: Column) -> Column:
    """The bits as text; the only bucket of a directory of depth 0 is the empty text."""
    return F.when(depth == 0, F.lit("")).otherwise(F.call_function("lpad", F.bin(prefix(h, depth)), depth.cast("int"), F.lit("0")))


def split(rows: DataFrame, limit: int, weight: str, h: str = "h") -> DataFrame:
    """``rows`` with ``depth`` (long), the number of leading bits of ``h`` that name the row's bucket.

    The directory doubles (one bit more) until every bucket weighs at most ``limit``, and only buckets above it split.
    Several doublings are done at once: loads are summed for the finest prefixes of a round, added up to the coarser
    ones, and the number of overfull ancestors of an entry is its depth. Entries that are still overfull at the end of
    a round go into the next one with their rows alone. Rows that share all bits can't be split; their bucket stays.
    Only sums of loads are shuffled besides one join of the rows with the directory, which has a row for each entry.
    """
    total = rows.agg(F.sum(weight).cast("double")).first()[0] or 0.0
    base, step = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + 2)
    open_rows, done = rows, []
    while True:
        depth = min(BITS, base + step)
        loads = open_rows.groupBy(prefix(F.col(h), depth).alias("_entry")).agg(
            F.sum(weight).alias("_load"), F.min(h).alias("_low"), F.max(h).alias("_high")
        )
        loads = cut(loads)
        above = loads.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("_depth"))
        above = above.withColumn("_part", F.expr(f"shiftrightunsigned(_entry, {depth} - _depth)"))
        overfull = (
            above.groupBy("_depth", "_part").agg(F.sum("_load").alias("_load"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
            .where(f"_load > {limit} AND _low < _high").select("_depth", "_part", F.lit(1).alias("_over"))
        )
        directory = cut(
            above.select("_entry", "_depth", "_part").join(overfull, ["_depth", "_part"], "left")
            .groupBy("_entry").agg((F.sum(F.coalesce("_over", F.lit(0))) + base).alias("depth"))
        )
        placed = open_rows.join(directory, prefix(F.col(h), depth) == F.col("_entry")).drop("_entry")
        if depth >= BITS or not directory.where(f"depth > {depth}").limit(1).count():
            done.append(placed.withColumn("depth", F.least("depth", F.lit(depth).cast("long"))))
            break
        done.append(placed.where(f"depth <= {depth}"))
        open_rows = cut(placed.where(f"depth > {depth}").drop("depth"))
        base, step = depth, 8
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
