"""Dated snapshots of located pois, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_cells(cell: DataFrame) -> DataFrame:
    """Located pois per (layer, cell), subtypes summed."""
    return cell.groupBy("layer", "i", "j").agg(F.sum("count").alias("count"))

def snapshot_layers(cells: DataFrame) -> DataFrame:
    """Occupied cells and total per layer."""
    return cells.groupBy("layer").agg(
        F.count("*").alias("located_cells"), F.sum("count").alias("total_count")
    )

def stage_and_commit(cells: DataFrame, path: str, batch: str) -> None:
    """Writes dated cells under ``taken_on`` and ``batch``, then says so in the manifest; readers see only what it names.

    A writer that dies before the commit leaves files that nobody reads and that the next try with the same ``batch``
    replaces. Doing it again with the same cells changes nothing.
    """
    staged = cells.withColumn("batch", F.lit(batch))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("taken_on", "batch").parquet(path)
    commit(staged.select(F.col("taken_on").cast("string").alias("taken_on"), "batch").distinct(), path, batch)

def commit(entries: DataFrame, path: str, batch: str) -> None:
    """One folder of the manifest per batch, which Spark's committer puts in place as a whole."""
    entries.coalesce(1).write.mode("overwrite").json(f"{path}/_commits/batch-{batch}")

def committed(spark, path: str) -> DataFrame:
    """``(taken_on, batch)`` of everything that was written to its end."""
    kinds = "taken_on string, batch string"
    try:
        return spark.read.schema(kinds).json(f"{path}/_commits/*")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], kinds)
        raise

def has_snapshot(spark, path: str, taken_on: str) -> bool:
    """Whether the date was committed; only the manifest is looked at."""
    day = F.lit(taken_on).cast("date")
    return not committed(spark, path).where(F.col("taken_on").cast("date") == day).limit(1).isEmpty()

def append_snapshot(cells: DataFrame, path: str, taken_on: str) -> bool:
    """Adds a dated snapshot unless the date exists; True when it was written."""
    if has_snapshot(cells.sparkSession, path, taken_on):
        return False
    stage_and_commit(cells.withColumn("taken_on", F.lit(taken_on).cast("date")), path, f"whole-{taken_on}")
    return True

def read_snapshots(spark, path: str) -> DataFrame:
    """All committed snapshots under ``path``; what several batches brought for one cell is added up."""
    done = committed(spark, path).select(F.col("taken_on").cast("date").alias("taken_on"), "batch").distinct()
    if done.isEmpty():
        return spark.createDataFrame([], "taken_on date, layer string, i int, j int, count double")
    history = spark.read.parquet(path).withColumns({"taken_on": F.col("taken_on").cast("date"), "batch": F.col("batch").cast("string")})
    history = history.join(done, ["taken_on", "batch"], "left_semi")
    return history.groupBy("taken_on", "layer", "i", "j").agg(F.sum("count").alias("count"))

def list_snapshots(history: DataFrame) -> DataFrame:
    return history.groupBy("taken_on").agg(
        F.count_distinct("layer").alias("layers"), F.sum("count").alias("pois")
    )

def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells whose count differs; a missing side counts as 0."""
    keys = ["layer", "i", "j"]
    both = before.select(*keys, F.col("count").alias("_a")).join(
        after.select(*keys, F.col("count").alias("_b")), keys, "full_outer"
    )
    delta = F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))
    return both.select(*keys, delta.alias("delta")).where("delta <> 0")

def layer_changes(diff: DataFrame) -> DataFrame:
    return diff.groupBy("layer").agg(F.count("*").alias("cells"), F.sum("delta").alias("delta"))

def layer_totals_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Totals per layer that both snapshots have, and their difference."""
    a = snapshot_layers(before).select("layer", F.col("total_count").alias("before"))
    b = snapshot_layers(after).select("layer", F.col("total_count").alias("after"))
    return a.join(b, "layer").withColumn("delta", F.col("after") - F.col("before"))

def biggest_changes(diff: DataFrame, zone: DataFrame, limit: int = 10) -> DataFrame:
    """The cells that changed most, with their district and neighbourhood."""
    top = diff.orderBy(F.desc(F.abs("delta")), "layer", "i", "j").limit(limit)
    names = zone.select("i", "j", "gu", "dong")
    return top.join(names, ["i", "j"], "left").fillna("?", ["gu", "dong"])
