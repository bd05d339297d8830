"""Every category's job, each through its own operators."""

import pytest
from pyspark.sql import functions as F

from vicinity.operators import quality, stations
from vicinity.plans import category_tables, jobs
from vicinity.plans.registries import CATEGORIES

SITES = [(1, "한빛마을", "g", "d", 37.5, 127.0), (2, "먼단지", "g", "d", 37.52, 127.0), (3, "밖", "g", "d", 37.9, 127.5)]
PLACE = "poi_id int, name string, subtype string, lat double, lng double"


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "site_id int, name string, gu string, dong string, lat double, lng double")


@pytest.fixture(scope="module")
def sources(spark):
    rows = []
    for category in CATEGORIES.values():
        kinds = list(category.subtypes) or ["x"]
        rows += [(category.key, k, f"{category.key}{k}", kinds[k % len(kinds)], 37.5 + 0.0009 * (k + 1), 127.0) for k in range(4)]
    places = spark.createDataFrame(rows, f"category string, {PLACE}")
    out = {key: places.where(F.col("category") == key).drop("category") for key in CATEGORIES}
    lines = F.when(F.col("poi_id") == 1, F.array(F.lit("2호선"), F.lit("5호선"))).otherwise(F.array(F.lit("2호선")))
    out["subway"] = {"places": out["subway"].withColumn("lines", lines)}
    routes = spark.createDataFrame([(0, "143"), (0, "N26"), (1, "143"), (1, "7211"), (3, "9401")], "node_id int, route_name string")
    out["bus"] = {"places": out["bus"], "routes": routes}
    out["cctv"] = spark.createDataFrame([("a", 37.5005, 127.0, 2, "생활방범"), ("a", 37.5005, 127.0, 2, "생활방범"), ("b", 37.503, 127.0, 3, "어린이보호")], "agency string, lat double, lng double, cameras long, purpose string")
    chargers = [("S1", "한빛마을 주차장", "addr", 37.501, 127.0, True, False), ("S1", "한빛마을 주차장", "addr", 37.501, 127.0, False, False), ("S2", "시장", "한빛마을 앞", 37.507, 127.0, True, True)]
    raw = spark.createDataFrame(chargers, "station_id string, name string, address string, lat double, lng double, fast boolean, restricted boolean")
    raw = raw.selectExpr("*", "'op' AS operator", "'' AS use_time", "'01' AS kind", "true AS free", "fast AS available")
    rolled = stations.charger_stations(raw)
    out["ev_charger"] = rolled.withColumns({"poi_id": F.substring("station", 2, 1).cast("int"), "subtype": F.lit("x")})
    ring = [(37.4, 126.9), (37.4, 127.1), (37.6, 127.1), (37.6, 126.9), (37.4, 126.9)]
    edges = [(name, k, shared, *a, *b) for k, (name, shared) in enumerate((("한빛초 통학구역", False), ("두빛 공동통학구역", True))) for a, b in zip(ring, ring[1:])]
    out["school_zone"] = {
        "edges": spark.createDataFrame(edges, "polygon string, ord int, shared boolean, lat1 double, lng1 double, lat2 double, lng2 double"),
        "schools": spark.createDataFrame([("서울한빛초등학교", 37.502, 127.0), ("다른초", 37.0, 127.0)], "name string, lat double, lng double"),
    }
    return out


def test_every_category_runs(spark, sites, sources, tmp_path):
    report = {r["job"]: r for r in jobs.run_jobs(spark, jobs.baseline_jobs(sites, sources, str(tmp_path))).collect()}
    assert set(report) == set(CATEGORIES)
    assert {k: r["error"] for k, r in report.items() if r["status"] != "success"} == {}
    for key, category in CATEGORIES.items():
        assert report[key]["rows"] == len(SITES) and {category.metric, f"{category.metric}_score"} <= set(report[key]["columns"].split(","))
        table = spark.read.parquet(f"{tmp_path}/{key}")
        assert quality.dq_checks(table, category.spec()).where("level = 'ERROR'").isEmpty(), key


def row(spark, sites, sources, key, site=1):
    found = jobs.category_baseline(sites, sources[key], CATEGORIES[key])
    return found.where(F.col("site_id") == site).first().asDict()


def test_own_columns(spark, sites, sources):
    subway = row(spark, sites, sources, "subway")
    assert (subway["line_count_500m"], subway["transfer_count_500m"], subway["nearest_subway"], subway["nearest_transfer_station"]) == (2, 1, "subway0", "subway1")
    bus = row(spark, sites, sources, "bus")
    assert (bus["bus_route_count"], bus["main_bus_count"], bus["night_bus_count"], bus["express_bus_count"], bus["available_bus_routes"]) == (4, 1, 1, 1, "143, 7211, 9401, N26")
    cctv = row(spark, sites, sources, "cctv")
    assert (cctv["cctv_count_300m"], cctv["cctv_point_count_500m"], cctv["safety_count"]) == (2, 3, 2)
    charger = row(spark, sites, sources, "ev_charger")
    assert (charger["ev_charger_count_300m"], charger["fast_charger_count_1km"], charger["public_charger_count_1km"], charger["restricted_charger_count_1km"]) == (1, 2, 2, 1)
    assert charger["possible_inside_complex_count"] == 2 and charger["ev_charger_score"] == 45 + 5 + 4 + 2 - 2
    away = row(spark, sites, sources, "ev_charger", 3)
    assert (away["ev_charger_score"], away["ev_charger_level"], away["possible_inside_complex_count"]) == (0, "낮음", 0)
    zone = row(spark, sites, sources, "school_zone")
    assert (zone["assigned_elementary_school"], zone["elementary_school"], zone["assigned_elementary_distance_m"], zone["elementary_access_score"]) == ("한빛초", "서울한빛초등학교", 222, 88)
    assert (zone["match_count"], zone["normal_zone_count"], zone["shared_school_zone_names"]) == (2, 1, "두빛 공동통학구역")
    assert row(spark, sites, sources, "school_zone", 3)["elementary_access_score"] == 10
    both = [("서울한빛초등학교", 37.502, 127.0), ("한빛초", 37.505, 127.0)]
    named = sources["school_zone"] | {"schools": spark.createDataFrame(both, "name string, lat double, lng double")}
    near = category_tables.school_zone(sites, named).where("site_id = 1").first()
    assert (near["elementary_school"], near["assigned_elementary_distance_m"], near["elementary_access_score"]) == ("한빛초", 556, 62)
