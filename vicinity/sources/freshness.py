"""Whether a source has news since the last check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``state`` per source ``key``; both sides have ``updated_at``, the current one ``status``.

    Failed checks keep their status; then no date, first check, update available, up to date.
    """
    before = previous.select("key", F.col("updated_at").alias("_before"))
    state = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.coalesce("updated_at", F.lit("")) == "", "checked_no_remote_date")
        .when(F.coalesce("_before", F.lit("")) == "", "first_check")
        .when(F.col("updated_at") != F.col("_before"), "update_available")
        .otherwise("up_to_date")
    )
    return current.join(before, "key", "left").withColumn("state", state).drop("_before")
