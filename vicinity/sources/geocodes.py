"""Coordinates from approved overrides and from earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["name", "gu", "dong"]


def fill_blank_coordinates(sites: DataFrame, approved: DataFrame) -> DataFrame:
    """Fills rows without coordinates from approved ones with the same key; adds ``filled``."""
    given = approved.select(*KEY, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    blank = F.col("lat").isNull() | F.col("lng").isNull()
    use = blank & F.col("_lat").isNotNull()
    joined = sites.join(given, KEY, "left").withColumn("filled", F.coalesce(use, F.lit(False)))
    return joined.withColumns(
        {c: F.when(F.col("filled"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lat", "lng")}
    ).drop("_lat", "_lng")


def unmatched_overrides(sites: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved keys that no blank site has."""
    blank = sites.where(F.col("lat").isNull() | F.col("lng").isNull())
    return approved.join(blank.select(*KEY), KEY, "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be geocoded: those without coordinates from an earlier run."""
    settled = done.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(key)
    return rows.join(settled, key, "left_anti")


def merge_geocoded(done: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Earlier rows stay as they are; fresh ones are added for other keys."""
    return done.unionByName(fresh.join(done.select(key), key, "left_anti"), allowMissingColumns=True)
