"""The click log as a stream: filtered, hashed, written by day, and summed as it arrives."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.display import local_day, visitor_hash
from ..functions.rules import is_bot
from ..operators.events import PAGE, RESULT, SEARCH
from ..operators.snapshots import stage_and_commit

CLICK_SCHEMA = (
    "ts timestamp, event_type string, ip string, user_agent string, path string, apartment string, apartment_gu string, "
    "apartment_dong string, src string, combo_key string, combo_json string, result_count long"
)


def read_clicks(spark: SparkSession, path: str, file_format: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """New click files as they appear; a bound on files per batch takes the place of a full queue."""
    return (
        spark.readStream.format(file_format).schema(CLICK_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def event_stream(clicks: DataFrame, seed: str, excluded_ips: Sequence[str] = (), zone: str = "Asia/Seoul") -> DataFrame:
    """Human clicks with their local day and a visitor hash that changes daily; no address remains.

    The same expressions serve a batch of clicks and a stream.
    """
    kept = clicks.where(~is_bot("user_agent"))
    if excluded_ips:
        kept = kept.where(~F.coalesce(F.col("ip").isin(list(excluded_ips)), F.lit(False)))
    day = local_day("ts", zone)
    return kept.withColumns({"day": day, "visitor_hash": visitor_hash("ip", "user_agent", day, seed)}).drop("ip", "user_agent")


def write_events(events: DataFrame, path: str, checkpoint: str, seconds: int = 10, once: bool = False) -> StreamingQuery:
    """Appends to Parquet by day, exactly once per checkpoint; ``once`` takes what is there and ends."""
    writer = (
        events.writeStream.format("parquet").partitionBy("day").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    trigger = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return trigger.start()


def _daily(zone_hours: int) -> Column:
    return F.window("ts", "1 day", startTime=f"{24 - zone_hours} hours")


def _kpis(events: DataFrame) -> DataFrame:
    one = lambda *kinds: F.when(F.col("event_type").isin(*kinds), 1).otherwise(0)
    return events.withColumns({"_page": one(PAGE), "_search": one(RESULT, SEARCH)})


def daily_kpis(events: DataFrame, late: str = "1 day", zone_hours: int = 9) -> DataFrame:
    """Running counts per local day as tumbling windows; rows later than the watermark are dropped.

    Fit for every output mode, so a day can be watched as it grows; visitors are approximate for that. ``closed_days``
    counts them exactly once a day is over.
    """
    sums = _kpis(events).withWatermark("ts", late).groupBy(_daily(zone_hours)).agg(
        F.sum("_page").alias("page_views"), F.sum("_search").alias("searches"), F.approx_count_distinct("visitor_hash").alias("visitors"),
    )
    day = F.to_date(F.col("window.start") + F.expr(f"INTERVAL {zone_hours} HOURS"))
    return sums.select(day.alias("day"), "page_views", "searches", "visitors")


def closed_days(events: DataFrame, late: str = "1 day", zone_hours: int = 9) -> DataFrame:
    """Exact counts of every local day that the watermark has passed (append mode).

    Two windows in a row: the first keeps one entry of state for each day and visitor, however often they click, and
    hands them on when the day is closed; the second adds a day up. Both are dropped at the watermark. A visitor
    without hash is counted in the sums, not as a visitor, like in the batch report.
    """
    per_visitor = _kpis(events).withWatermark("ts", late).groupBy(_daily(zone_hours), "visitor_hash").agg(
        F.sum("_page").alias("_page"), F.sum("_search").alias("_search")
    )
    per_day = per_visitor.groupBy(F.window(F.window_time("window"), "1 day", startTime=f"{24 - zone_hours} hours")).agg(
        F.sum("_page").alias("page_views"), F.sum("_search").alias("searches"), F.count("visitor_hash").alias("visitors")
    )
    day = F.to_date(F.col("window.start") + F.expr(f"INTERVAL {zone_hours} HOURS"))
    return per_day.select(day.alias("day"), "page_views", "searches", "visitors")


def combo_counts(events: DataFrame, event_type: str = SEARCH) -> DataFrame:
    """Running count per combination (complete mode)."""
    return events.where(F.col("event_type") == event_type).groupBy("combo_key").agg(F.count("*").alias("count"))


def accumulate_snapshots(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Dated snapshots from a stream of ``(taken_on, layer, i, j, count)``.

    Each micro-batch is staged and committed under the stream's and its own number, and a replay overwrites just that;
    so a date may arrive in any number of batches, and ``snapshots.append_snapshot`` may write to the same folder.
    ``snapshots.read_snapshots`` adds the batches of a date up.
    """
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("taken_on", "layer", "i", "j").agg(F.sum("count").alias("count"))
        stage_and_commit(sums, path, f"{stream}-{batch_id}")

    return (
        cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
