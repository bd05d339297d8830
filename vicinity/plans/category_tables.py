"""What single categories know beyond counts around a site: lines, routes, cameras, chargers, school zones.

Each function takes the sites and the sources of its category (a mapping) and returns columns by ``site_id``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.display import school_score
from ..functions.geo import haversine_m, whole_metres
from ..operators import baseline, cameras, polygons, radius, search, stations

# Route types, camera purposes with their columns, words that a zone's name drops.
BUS_TYPES = ["main", "local", "express", "night", "village", "airport"]
CAMERA_PURPOSES = {"생활방범": "safety", "어린이보호": "child", "교통/단속": "traffic", "시설안전": "facility"}
ZONE_WORDS = ["통학구역", "공동통학구역"]
CHARGER_SUMS = {
    "fast_count": "fast_charger_count_1km", "slow_count": "slow_charger_count_1km", "restricted_count": "restricted_charger_count_1km",
    "public_count": "public_charger_count_1km", "free_parking_count": "free_parking_count_1km", "available_count": "available_charger_count_1km",
}


def _points(sites: DataFrame) -> DataFrame:
    return sites.select("site_id", "lat", "lng")


def subway(sites: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Lines and transfer stations within 500 and 1,000 m, the nearest station and the nearest transfer.

    ``places`` has ``lines`` (array) besides the columns of every place.
    """
    places = sources["places"]
    counts = baseline.line_counts(_points(sites), places).drop("lat", "lng", "station_count_500m", "station_count_1000m")
    label = F.array_join("lines", "·").alias("nearest_subway_lines")
    near = radius.nearest_within(sites, places, 1500, keep=("name", "lines")).select(
        "site_id", F.col("name").alias("nearest_subway"), F.col("distance_m").alias("subway_distance"), label
    )
    transfer = radius.nearest_within(sites, places.where(F.size("lines") >= 2), 1000, keep=("name",)).select(
        "site_id", F.col("name").alias("nearest_transfer_station"), F.col("distance_m").alias("nearest_transfer_distance")
    )
    return counts.join(near, "site_id", "left").join(transfer, "site_id", "left")


def bus(sites: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct routes within 500 m, by type, with the first 20; ``routes``: ``node_id, route_name``; a stop's id is its node."""
    stops = sources["places"].withColumnRenamed("poi_id", "node_id")
    access = baseline.route_access(_points(sites), stops, sources["routes"], rules.bus_type("route_name"), BUS_TYPES)
    access = access.withColumnsRenamed({"route_count": "bus_route_count", "available_routes": "available_bus_routes"} | {f"{x}_count": f"{x}_bus_count" for x in BUS_TYPES})
    return access.drop("lat", "lng")


def cctv(sites: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Cameras and registered points within 300 and 500 m; purposes within 500 m. ``places``: ``agency, cameras, purpose, lat, lng``."""
    counts = cameras.weighted_camera_counts(_points(sites), sources["places"], (300, 500), CAMERA_PURPOSES).drop("lat", "lng")
    named = {f"camera_count_{r}m": f"cctv_count_{r}m" for r in (300, 500)} | {f"point_count_{r}m": f"cctv_point_count_{r}m" for r in (300, 500)}
    return counts.withColumnsRenamed(named)


def ev_charger(sites: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Chargers of the stations within 1,000 m, stations that may be inside the complex, score and level.

    ``places``: ``charger_stations`` with ``poi_id``.
    """
    places = sources["places"].select("poi_id", F.col("name").alias("station_name"), "address", "lat", "lng", "charger_count", *CHARGER_SUMS)
    pairs = radius.radius_join(sites.select("site_id", "name", "lat", "lng"), places, 1000)
    near = lambda r: F.count_if(F.col("distance_m") <= r).alias(f"_near_{r}")
    first = F.min(F.struct("distance_m", "poi_id", "station_name"))
    sums = pairs.groupBy("site_id").agg(
        near(300), near(500), near(1000), *(F.sum(c).alias(name) for c, name in CHARGER_SUMS.items()),
        F.count_if(stations.inside_complex("name", "station_name", "address")).alias("possible_inside_complex_count"), first.alias("_first"),
    )
    out = sites.select("site_id").join(sums, "site_id", "left").fillna(0, [*CHARGER_SUMS.values(), "possible_inside_complex_count"])
    score = stations.charger_access("_near_300", "_near_500", "_near_1000", *(CHARGER_SUMS[c] for c in ("fast_count", "public_count", "restricted_count")))
    scored = out.withColumn("ev_charger_score", score).withColumn("ev_charger_level", stations.access_level(F.col("ev_charger_score")))
    return scored.select(
        "site_id", F.col("_first.station_name").alias("nearest_ev_charger_name"), F.col("_first.distance_m").alias("nearest_ev_charger_distance"),
        *CHARGER_SUMS.values(), "possible_inside_complex_count", "ev_charger_score", "ev_charger_level",
    )


def school_zone(sites: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """The school zone of each site, its school, the distance there and the access score.

    ``edges``: zone rings (``polygon, ord, shared, ...``); ``schools``: ``name, lat, lng``. Of schools with one name the
    first by place counts. A site in no zone, or in one without a known school, scores as unknown.
    """
    located = polygons.primary_zone(polygons.points_in_polygons(_points(sites), sources["edges"]))
    clean = F.col("zone")
    for word in ZONE_WORDS:
        clean = F.replace(clean, F.lit(word), F.lit(""))
    located = located.withColumn("assigned_elementary_school", F.trim(clean))
    schools = sources["schools"].where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(F.col("name").alias("school"))
    schools = schools.agg(F.min(F.struct("lat", "lng")).alias("_at"))
    zones = located.select(F.col("assigned_elementary_school").alias("zone")).where("zone <> ''").distinct()
    found = search.resolve_school(zones, schools.select("school")).join(schools, "school")
    found = found.select(F.col("zone").alias("assigned_elementary_school"), F.col("school").alias("elementary_school"), "_at")
    metres = whole_metres(haversine_m("lat", "lng", F.col("_at.lat"), F.col("_at.lng")))
    out = located.join(found, "assigned_elementary_school", "left").withColumn("assigned_elementary_distance_m", metres)
    return out.select(
        "site_id", F.col("zone").alias("primary_school_zone_name"), "assigned_elementary_school", "elementary_school", "assigned_elementary_distance_m",
        school_score("assigned_elementary_distance_m").alias("elementary_access_score"), F.col("shared_zones").alias("shared_school_zone_names"),
        "match_count", (F.col("match_count") - F.col("shared_count")).alias("normal_zone_count"), F.col("shared_count").alias("shared_zone_count"),
    )


#: Columns that come on top of the counts around a site, and tables that take their place.
BESIDE = {"subway": subway, "bus": bus, "ev_charger": ev_charger}
INSTEAD = {"cctv": cctv, "school_zone": school_zone}
