"""XML item feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a charger item.
CHARGER_FIELDS = [
    "statId", "statNm", "addr", "lat", "lng", "chgerType", "output", "limitYn", "limitDetail", "parkingFree", "stat",
    "delYn", "useTime", "busiNm", "zcode", "method",
]


def read_xml_items(spark: SparkSession, path: str, row_tag: str = "item", fields: list[str] = CHARGER_FIELDS) -> DataFrame:
    """One row per ``row_tag`` element with the given text fields; large files are split by Spark."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
