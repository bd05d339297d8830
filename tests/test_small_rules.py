"""Small rules that other operators build on: literal vectors."""

import datetime

from pyspark.sql import functions as F

from vicinity.functions import display, text as tx
from vicinity.operators import events, explore, stations
from vicinity.sources import geocodes


def test_texts_and_days(spark):
    rows = spark.createDataFrame([(1, 0.125, ["한강공원", "", "서울숲", "아주 긴 이름의 어린이공원 제이십삼호 놀이터 옆 작은 숲"]), (2, 2.0, ["a", "a", "b"]), (3, None, [])], "id int, x double, names array<string>")
    got = {r["id"]: (r["t"], r["l"], r["d"]) for r in rows.select("id", display.two_decimals("x").alias("t"), tx.compact_list("names", 3).alias("l"), display.day_floor(F.lit("2024-03-01").cast("date"), 7).alias("d")).collect()}
    assert got[1] == ("0.12", "한강공원, 서울숲", datetime.date(2024, 2, 24))
    assert got[2][:2] == ("2.00", "a, b") and got[3][1] == ""
    assert spark.range(1).select(display.day_floor(F.current_date(), 0).alias("d")).first()["d"] is None


def test_chargers_of_the_city(spark):
    rows = [(1, "서울특별시 중구", None, 0.0, 0.0), (2, None, "11680", 0.0, 0.0), (3, "부산", "26", 37.55, 126.98), (4, "부산", "26", 35.1, 129.0), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, address string, zone string, lat double, lng double")
    kept = df.where(F.coalesce(stations.in_city("address", "zone", "lat", "lng"), F.lit(False)))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3]


def test_geocodes(spark):
    site = "name string, gu string, dong string, lat double, lng double"
    sites = spark.createDataFrame([("a", "g", "d", None, None), ("b", "g", "d", 1.0, 2.0)], site)
    approved = spark.createDataFrame([("a", "g", "d", 5.0, 6.0), ("b", "g", "d", 7.0, 8.0), ("c", "g", "d", 9.0, 9.0)], site)
    assert sorted(r["name"] for r in geocodes.unmatched_overrides(sites, approved).collect()) == ["b", "c"]
    done = spark.createDataFrame([(1, 1.0, "old")], "key int, lat double, source string")
    fresh = spark.createDataFrame([(1, 9.0), (2, 2.0)], "key int, lat double")
    merged = {r["key"]: (r["lat"], r["source"]) for r in geocodes.merge_geocoded(done, fresh, "key").collect()}
    assert merged == {1: (1.0, "old"), 2: (2.0, None)}


def test_filters():
    raw = {"gu": " 중구 ", "price_type": "rent", "price": "o350000", "household": "u1", "bus_type": "광역", "area": "u60", "priority": ["medical:치과", "nothing:x"], "unknown": "z"}
    got = explore.normalize_filters(raw)
    assert (got["gu"], got["price_type"], got["price"], got["household"], got["bus_type"], got["area_buckets"]) == ("중구", "trade", "o350000", "", "광역", ["u60"])
    assert "unknown" not in got and all(x in explore.PRIORITY_SUBTYPES for x, _ in got["priorities"])
    assert explore.has_filters(got)
    blank = explore.normalize_filters({"price_type": "jeonse", "price": "o350000", "area_buckets": ["no"]})
    assert not explore.has_filters(blank) and blank["price_type"] == "jeonse"


def test_event_report(spark):
    rows = [(k, f"2024-01-0{1 + k % 3}", "page_view" if k % 2 else "explore_search", f"v{k % 4}", k % 3, "home", None, None, 2.0) for k in range(12)]
    kinds = "event_id int, d string, event_type string, visitor_hash string, site_id int, src string, combo_key string, combo_json string, result_count double"
    df = spark.createDataFrame(rows, kinds).withColumns({"day": F.col("d").cast("date"), "ts": F.col("d").cast("timestamp_ntz")}).drop("d")
    every = events.event_report(df)
    part = events.event_report(df, "2024-01-02", "2024-01-02")
    assert {k: set(x.columns) for k, x in every.items()} == {k: set(x.columns) for k, x in part.items()}
    assert every["daily"].count() == 3 and part["daily"].count() == 1
