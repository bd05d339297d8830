"""Writing baselines and per-site payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import col


def shard_of(name) -> Column:
    """The 16 hex digits under which a site's payload is stored."""
    return F.substring(F.sha1(col(name).cast("binary")), 1, 16)


def write_baseline(df: DataFrame, folder: str, name: str, csv: bool = False) -> None:
    """A baseline as Parquet; ``csv`` adds a text copy with item lists as JSON."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if csv:
        nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
        flat = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")


def baseline_columns(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Only the wanted columns; Parquet reads no others."""
    return spark.read.parquet(f"{folder}/{name}").select(*columns)


def write_detail_shards(payloads: DataFrame, path: str) -> None:
    """Payloads ``(name, payload)`` filed under the first two digits of their shard.

    256 folders whatever the number of sites; a lookup filters on folder and shard. The manifest
    is the table's own ``name, shard`` columns.
    """
    shard = shard_of("name")
    rows = payloads.withColumns({"shard": shard, "folder": F.substring(shard, 1, 2)})
    rows.repartition("folder").sortWithinPartitions("folder", "shard").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_detail(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The payload of one site: one folder, and row groups by the shard's statistics."""
    shard = spark.range(1).select(shard_of(F.lit(name)).alias("s")).first()["s"]
    table = spark.read.parquet(path)
    return table.where((F.col("folder") == shard[:2]) & (F.col("shard") == shard) & (F.col("name") == name))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name", "shard")
