"""Sharding by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_name, hash_bits, split


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (the leading hash bits as text), ``shard_depth`` and ``shard_row_bytes``.

    Rows go by the md5 of their id. A shard splits on another bit only while the UTF-8 bytes of its texts exceed
    ``limit``. A missing id hashes like the empty text, a missing text has no bytes. One text above the limit, or rows
    that share one id, stay together in a shard above it. Columns of the same names are replaced.
    """
    names = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_row_bytes")]
    rows = docs.select(  # under names of its own, no column of the input meets one of the directory
        *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)),
        hash_bits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_h"),
        F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("shard_row_bytes"),
    )
    placed = split(rows, limit, "shard_row_bytes", "_h")
    return placed.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), bucket_name(F.col("_h"), F.col("depth")).alias("shard"),
        F.col("depth").alias("shard_depth"), "shard_row_bytes",
    )


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every shard to its own folder ``shard=<bits>`` below ``path``; a shard is written by one task."""
    placed = shard(docs, limit, id_col, text_col)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
