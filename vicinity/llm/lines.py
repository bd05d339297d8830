"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, release, scratch_dir

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z as a-z."""
    bare = F.call_function("btrim", line, F.lit(_BLANK))
    # for plain ASCII, lower() changes A-Z only and is much faster
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


class Runs:
    """Sorted runs of ``(key, n, last)``: in how many documents a line was seen, and the largest id.

    A batch adds one run on level 0, sorted and bucketed by key. When a level has ``fanout`` runs, they are merged
    into one run of the next level, so a key is rewritten once for each level, of which there are logarithmically many.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, shares: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.shares = shares or partitions(spark)
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"llm_run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.shares, "key").sortBy("key")
        writer.option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of distinct ``(key, id)`` rows; returns its keys that no run held (a merge anti join with each)."""
        seen = batch.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        run = self._write(seen.repartition(self.shares, "key"))
        fresh = run.select("key")
        for older in self.runs():
            fresh = fresh.join(older.select("key"), "key", "left_anti")
        self._push(0, run)
        return fresh

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(_merge(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    def merged(self) -> DataFrame:
        """All runs as one."""
        return _merge(self.runs())


def _merge(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs merged two by two: both sides are bucketed and sorted by key, so the join shuffles nothing."""
    rows = runs[0]
    for run in runs[1:]:
        other = run.select("key", F.col("n").alias("_n"), F.col("last").alias("_last"))
        rows = rows.join(other, "key", "full_outer").select(
            "key", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("last", "_last").alias("last")
        )
    return rows


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)``: texts without lines that many documents share.

    A line whose key (see ``line_key``) has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents stays only in the one with the largest id. Lines end at ``\\n``; a missing or empty text is one empty
    line. Rows with one id count as one document and share what is dropped; a missing id is an id below all others.
    Documents are taken in ``batches`` by their id's hash; each goes through the runs once. Other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    keyed = docs.select(F.col("_id").alias("id"), F.explode(F.split("_text", "\n", -1)).alias("line"))
    keyed = keyed.select("id", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = keyed.select(_hash(F.col("line")).alias("key"), "id").distinct()
    keyed = keyed.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    keyed.write.partitionBy("batch").parquet(path := f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}")
    release(spark)
    keyed = spark.read.schema("key binary, id " + dict(docs.dtypes)["_id"] + ", batch int").parquet(path)
    runs = Runs(spark)
    for batch in range(batches):
        runs.add(keyed.where(F.col("batch") == batch).select("key", "id"))
    shared = runs.merged().where(F.col("n") >= min_docs).select("key", "last")
    gone = keyed.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("last")))
    gone = cut(gone.groupBy("id").agg(F.collect_list("key").alias("gone")))  # at most the lines of one document
    release(spark)
    lines = docs.join(gone, docs["_id"].eqNullSafe(gone["id"]), "left").withColumn("lines", F.split("_text", "\n", -1))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~(F.array_contains(F.col("gone"), _hash(line_key(x))) & (F.char_length(line_key(x)) >= min_chars)))
    )
    return lines.withColumn("kept", kept).select(
        F.col("_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"),
    )
