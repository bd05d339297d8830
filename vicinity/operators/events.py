"""Click statistics over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_even

# Event types.
PAGE, RESULT, SEARCH = "page_view", "result_view", "explore_search"


def between_days(events: DataFrame, day_from=None, day_to=None) -> DataFrame:
    if day_from is not None:
        events = events.where(F.col("day") >= F.lit(day_from).cast("date"))
    if day_to is not None:
        events = events.where(F.col("day") <= F.lit(day_to).cast("date"))
    return events


def _is(*types: str) -> Column:
    return F.coalesce(F.col("event_type").isin(*types), F.lit(False))


def kpis(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_if(_is(PAGE)).alias("page_views"), F.count_if(_is(RESULT)).alias("result_views"),
        F.count_if(_is(SEARCH)).alias("explore_searches"), F.count_distinct("visitor_hash").alias("unique_visitors"),
    )


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy("day").agg(
        F.count_if(_is(PAGE)).alias("page_views"), F.count_distinct("visitor_hash").alias("unique_visitors"),
        F.count_if(_is(RESULT, SEARCH)).alias("searches"),
    )


def _top(events: DataFrame, event_type: str, by: list, top: int | None, *extra: Column) -> DataFrame:
    """Counts and visitors by key for one event type, largest first, ties by key.

    Spark plans the distinct count in two stages on (key, visitor), so a key that takes a third of
    all events is spread over its visitors first.
    """
    rows = events.where(F.col("event_type") == event_type)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("count"), F.count_distinct("visitor_hash").alias("visitors"), *extra
    )
    names = out.columns[: len(by)]
    return out if top is None else out.orderBy(F.desc("count"), *names).limit(top)


def top_sites(events: DataFrame, top: int = 20) -> DataFrame:
    return _top(events.where("site_id IS NOT NULL"), RESULT, ["site_id"], top)


def top_weight_combos(events: DataFrame, top: int = 20) -> DataFrame:
    key = F.coalesce(F.nullif("combo_key", F.lit("")), F.lit("(기본값)")).alias("combo_key")
    return _top(events, RESULT, [key], top, F.max("combo_json").alias("sample"))


def top_filter_combos(events: DataFrame, top: int = 20) -> DataFrame:
    key = F.coalesce(F.nullif("combo_key", F.lit("")), F.lit("(필터없음)")).alias("combo_key")
    average = half_even(F.avg("result_count"), 1).alias("avg_results")
    return _top(events, SEARCH, [key], top, F.max("combo_json").alias("sample"), average)


def source_mix(events: DataFrame) -> DataFrame:
    src = F.coalesce(F.nullif("src", F.lit("")), F.lit("(미상)")).alias("src")
    return events.where(F.col("event_type") == RESULT).groupBy(src).agg(F.count("*").alias("count"))


def search_sizes(events: DataFrame) -> DataFrame:
    """How many results searches return, and how often none."""
    found = events.where(F.col("event_type") == SEARCH)
    out = found.agg(
        F.count("*").alias("searches"), half_even(F.avg("result_count"), 1).alias("avg_results"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"),
    )
    share = half_even(F.col("zero_results") * 100.0 / F.nullif("searches", F.lit(0)), 1)
    return out.withColumn("zero_result_pct", share)


def event_report(events: DataFrame, day_from=None, day_to=None, top: int = 20) -> dict[str, DataFrame]:
    """All statistics of a date range."""
    rows = between_days(events, day_from, day_to)
    return {
        "kpi": kpis(rows), "daily": daily(rows), "top_sites": top_sites(rows, top),
        "top_weight_combos": top_weight_combos(rows, top), "top_filter_combos": top_filter_combos(rows, top),
        "source_mix": source_mix(rows), "search_sizes": search_sizes(rows),
    }
