"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import BITS, bucket_name, split
from .common import cut, release

#: Distinct texts in a bucket of the index.
CAPACITY = 4096


def normalised(text: Column) -> Column:
    """Every run of white space as one space; a missing text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def build_index(texts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index of ``texts`` (``_id``, ``_text``, ``_h``): one entry for each distinct text, with its first id and count.

    Grouping by hash and text compares bytes: two texts with one hash are two entries of the same chain. Copies are
    folded before they are shuffled. Overfull buckets split; the entries are written in order of their bucket, so each
    task owns a range of keys, to files that all executors share.
    """
    entries = cut(
        texts.groupBy("_h", "_text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_h", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size", F.lit(1).alias("_one"))
    )
    release(texts.sparkSession)
    placed = split(entries, capacity, "_one", "_h").withColumn("bucket", bucket_name(F.col("_h"), F.col("depth")))
    return cut(placed.drop("_one", "depth").repartitionByRange("bucket").sortWithinPartitions("bucket", "_h", "text_sha256"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, bucket)`` for every row of ``docs``.

    Texts are equal when they agree after runs of white space became one space. A missing text is empty. Of equal
    texts the smallest id stays; a missing id comes after all others. Rows that repeat an id and a text count each and
    have the same ``kept``. Other columns aren't read, so their names can't clash; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col).cast("string")).alias("_text"))
    texts = texts.withColumn("_h", F.expr(f"shiftrightunsigned(xxhash64(_text), {64 - BITS})"))
    index = build_index(texts, capacity)
    keys = texts.select("_id", "_h", F.sha2("_text", 256).alias("text_sha256"))
    found = keys.join(index, ["_h", "text_sha256"])
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat id and text, one.

    Rows without id, and rows that share an id, are told apart by their texts.
    """
    sha = "_sha"
    while sha in map(str.lower, docs.columns):
        sha += "_"
    stay = copies(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_keep_sha")).distinct()
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text_col).cast("string")), 256))
    rows = rows.join(stay, rows[id_col].eqNullSafe(stay["_keep"]) & (rows[sha] == stay["_keep_sha"]), "left_semi")
    return rows.dropDuplicates([id_col, sha]).drop(sha)
