"""Queries around a site: distances, counts, items, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..functions.rules import BUS_TYPES, bus_type
from ..operators import baseline, cameras, radius, scoring
from . import jobs, tables as t
from .registries import CATEGORIES
from .registry import query
from .tables import sql_metres, sql_raw_metres, with_ctes

_PAIRS = {"pair": f"SELECT s.site_id, p.*, {sql_metres('s', 'p')} AS d FROM site s, poi p"}


@query(
    "site_radius_counts",
    with_ctes(
        "site poi",
        """SELECT s.site_id, count(d) FILTER (d<=300) AS count_300m, count(d) FILTER (d<=500) AS count_500m,
        count(d) FILTER (d<=1000) AS count_1000m, count(d) FILTER (d<=3000) AS count_3000m,
        min(d) FILTER (d<=3000) AS nearest_distance
        FROM site s LEFT JOIN pair USING (site_id) GROUP BY 1""",
        _PAIRS,
    ),
)
def site_radius_counts(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    return baseline.radius_counts(sites, t.poi(spark, d), [300, 500, 1000, 3000]).drop("lat", "lng")


@query(
    "site_radius_counts_raw_distance",
    with_ctes(
        "site poi",
        f"""SELECT s.site_id, count(*) FILTER (d<=300) AS count_300m, count(*) FILTER (d<=500) AS count_500m
        FROM (SELECT site_id, {sql_raw_metres('site', 'poi')} AS d FROM site, poi) s GROUP BY 1""",
    ),
)
def site_radius_counts_raw_distance(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    counts = baseline.radius_counts(sites, t.poi(spark, d), [300, 500], rounding="after")
    return counts.select("site_id", "count_300m", "count_500m")


@query(
    "site_nearest_poi",
    with_ctes(
        "site poi",
        "SELECT site_id, poi_id, d AS distance_m FROM pair "
        "QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, poi_id) = 1",
        _PAIRS,
    ),
)
def site_nearest_poi(spark, d):
    return radius.nearest(t.site(spark, d), t.poi(spark, d)).select("site_id", "poi_id", "distance_m")


@query(
    "site_nearest_anchor",
    with_ctes(
        "site anchor",
        f"""SELECT site_id, poi_id, name, d AS distance_m FROM (
        SELECT s.site_id, a.poi_id, a.name, {sql_metres('s', 'a')} AS d FROM site s, anchor a)
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, poi_id) = 1""",
    ),
)
def site_nearest_anchor(spark, d):
    found = radius.nearest(t.site(spark, d), t.anchor(spark, d), keep=("name",))
    return found.select("site_id", "poi_id", "name", "distance_m")


@query(
    "site_nearest_within_by_layer",
    with_ctes(
        "site poi",
        "SELECT site_id, layer, poi_id, name, d AS distance_m FROM pair WHERE d <= 1500 "
        "QUALIFY row_number() OVER (PARTITION BY site_id, layer ORDER BY d, poi_id) = 1",
        _PAIRS,
    ),
)
def site_nearest_within_by_layer(spark, d):
    return radius.nearest_within(
        t.site(spark, d), t.poi(spark, d), 1500, by=("layer",), keep=("name",)
    )


@query(
    "site_knn",
    with_ctes(
        "site",
        f"""SELECT site_id, neighbour_id, d AS distance_m, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY d, neighbour_id) AS rank FROM (
        SELECT a.site_id, b.site_id AS neighbour_id, {sql_metres('a', 'b')} AS d
        FROM site a JOIN site b ON a.site_id <> b.site_id)) WHERE rank <= 5""",
    ),
)
def site_knn(spark, d):
    return radius.knn(t.site(spark, d), 5)


@query(
    "radius_query",
    with_ctes(
        "camera",
        f"""SELECT poi_id, d AS distance_m FROM (SELECT poi_id, {sql_metres('q', 'camera')} AS d
        FROM camera, (SELECT 37.55e0 AS lat, 126.95e0 AS lng) q) WHERE d <= 2000""",
    ),
)
def radius_query(spark, d):
    near = radius.radius_query(t.camera(spark, d), 37.55, 126.95, 2000, "poi_id")
    return near.select("poi_id", "distance_m")


@query(
    "sites_near_named_facility",
    with_ctes(
        "site anchor",
        f"""SELECT site_id, d AS distance_m FROM (SELECT s.site_id, {sql_metres('s', 'a')} AS d
        FROM site s, anchor a WHERE a.name = 'Supplier#000000007') WHERE d <= 1500""",
    ),
)
def sites_near_named_facility(spark, d):
    return radius.within_named(t.site(spark, d), t.anchor(spark, d), "Supplier#000000007")


@query(
    "school_environment",
    with_ctes(
        "site poi",
        "SELECT site_id, subtype, poi_id, d AS distance_m, rank FROM ("
        "SELECT *, row_number() OVER (PARTITION BY site_id, subtype ORDER BY d, poi_id) AS rank "
        "FROM pair WHERE d <= 1500) WHERE rank <= 8",
        _PAIRS,
    ),
)
def school_environment(spark, d):
    return radius.nearby_by_level(t.site(spark, d), t.poi(spark, d), "subtype")


SUBTYPES = {x: x.lower() for x in ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")}


@query(
    "site_subtype_pivot",
    with_ctes(
        "site poi",
        "SELECT *, "
        + " + ".join(f"({v}_count > 0)::INT" for v in SUBTYPES.values())
        + " AS diversity FROM (SELECT s.site_id, count(d) FILTER (d<=1500) AS total, "
        + ", ".join(
            f"count(d) FILTER (d<=1500 AND subtype='{k}') AS {v}_count, "
            f"min(d) FILTER (d<=1500 AND subtype='{k}') AS nearest_{v}"
            for k, v in SUBTYPES.items()
        )
        + " FROM site s LEFT JOIN pair USING (site_id) GROUP BY 1)",
        _PAIRS,
    ),
)
def site_subtype_pivot(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    return baseline.subtype_counts(sites, t.poi(spark, d), SUBTYPES, 1500).drop("lat", "lng")


BRANDS = {f"Brand#{k}": f"brand_{k}" for k in range(1, 26)}


@query(
    "site_brand_nearest",
    with_ctes(
        "site poi",
        "SELECT s.site_id, "
        + ", ".join(
            f"count(d) FILTER (d<=3000 AND brand='{k}') AS {v}_count, "
            f"min(d) FILTER (d<=3000 AND brand='{k}') AS nearest_{v}"
            for k, v in BRANDS.items()
        )
        + " FROM site s LEFT JOIN pair USING (site_id) GROUP BY 1",
        _PAIRS,
    ),
)
def site_brand_nearest(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    out = baseline.subtype_counts(sites, t.poi(spark, d), BRANDS, 3000, subtype="brand")
    return out.drop("lat", "lng", "total", "diversity")


@query(
    "cafe_access",
    with_ctes(
        "site poi",
        """SELECT site_id, total + 2*kinds AS access_raw, total + 2*kinds AS access_from_items FROM (
        SELECT s.site_id, count(d) AS total, count(DISTINCT brand) AS kinds
        FROM site s LEFT JOIN (SELECT * FROM pair WHERE d<=500 AND layer='cafe') USING (site_id)
        GROUP BY 1)""",
        _PAIRS,
    ),
)
def cafe_access(spark, d):
    """The raw score from counts, and again from the item lists."""
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    cafes = t.poi(spark, d).where("layer = 'cafe'").withColumn("subtype", F.col("brand"))
    counts = baseline.subtype_counts(sites, cafes, BRANDS, 500)
    counts = counts.select(
        "site_id",
        baseline.cafe_access([f"{v}_count" for v in BRANDS.values()]).cast("long").alias("access_raw"),
    )
    listed = baseline.items(sites, cafes, 500, 9999).select(
        "site_id",
        baseline.cafe_access_from_items("items", list(BRANDS)).cast("long").alias("access_from_items"),
    )
    return counts.join(listed, "site_id")


@query(
    "site_items",
    with_ctes(
        "site poi",
        """SELECT s.site_id, coalesce(string_agg(d || ':' || poi_id || ':' || p.name || ':' || subtype, '|'
        ORDER BY d, poi_id), '') AS items, count(d) AS n_items FROM site s LEFT JOIN (
        SELECT * FROM pair WHERE d<=1500 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, poi_id) <= 12
        ) p USING (site_id) GROUP BY 1""",
        _PAIRS,
    ),
)
def site_items(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    listed = baseline.items(sites, t.poi(spark, d), 1500, 12)
    text = F.transform(
        "items", lambda x: F.concat_ws(":", x["distance"], x["poi_id"], x["name"], x["subtype"])
    )
    return listed.select(
        "site_id",
        F.array_join(text, "|").alias("items"),
        F.size("items").cast("long").alias("n_items"),
    )


@query(
    "site_line_counts",
    with_ctes(
        "site poi",
        """SELECT s.site_id,
        count(DISTINCT brand) FILTER (d<=500) AS line_count_500m,
        count(DISTINCT brand) FILTER (d<=1000) AS line_count_1000m,
        coalesce(any_value(t5),0) AS transfer_count_500m, coalesce(any_value(t10),0) AS transfer_count_1000m,
        coalesce(any_value(s5),0) AS station_count_500m, coalesce(any_value(s10),0) AS station_count_1000m
        FROM site s LEFT JOIN near USING (site_id) LEFT JOIN (
          SELECT site_id, count(*) FILTER (d<=500 AND k>=2) AS t5, count(*) FILTER (k>=2) AS t10,
          count(*) FILTER (d<=500) AS s5, count(*) AS s10
          FROM (SELECT site_id, spot, any_value(d) AS d, count(DISTINCT brand) AS k FROM near GROUP BY 1,2)
          GROUP BY 1) USING (site_id) GROUP BY 1""",
        {
            "station": "SELECT brand, p2.spot, p2.lat, p2.lng FROM poi JOIN "
            "(SELECT poi_id AS spot, lat, lng FROM poi) p2 ON p2.spot = poi.poi_id - poi.poi_id % 3",
            "near": f"SELECT s.site_id, p.brand, p.spot, {sql_metres('s', 'p')} AS d "
            f"FROM site s, station p WHERE {sql_metres('s', 'p')} <= 1000",
        },
    ),
)
def site_line_counts(spark, d):
    """Stations: three neighbouring keys share one place, brands are the lines."""
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    poi = t.poi(spark, d)
    spot = poi.select(F.col("poi_id").alias("spot"), "lat", "lng")
    lines = poi.select("brand", (F.col("poi_id") - F.col("poi_id") % 3).alias("spot"))
    stations = (
        lines.groupBy("spot")
        .agg(F.array_sort(F.collect_set("brand")).alias("lines"))
        .join(spot, "spot")
        .withColumnRenamed("spot", "poi_id")
    )
    return baseline.line_counts(sites, stations).drop("lat", "lng")


@query(
    "site_route_access",
    with_ctes(
        "site anchor route",
        f"""SELECT s.site_id, count(route_name) AS route_count, """
        + ", ".join(f"count(*) FILTER (kind='{k}') AS {k}_count" for k in BUS_TYPES)
        + """, string_agg(route_name, ', ' ORDER BY route_name) FILTER (rn<=20) AS available_routes
        FROM site s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY route_name) AS rn,
        CASE WHEN route_name[1]='6' THEN 'airport' WHEN length(route_name)=3 THEN 'main'
        WHEN route_name[1]='9' THEN 'express' ELSE 'unknown' END AS kind FROM reach) USING (site_id) GROUP BY 1""",
        {
            "reach": f"SELECT DISTINCT s.site_id, r.route_name FROM site s JOIN anchor a "
            f"ON {sql_raw_metres('s', 'a')} <= 1000 JOIN route r ON r.node_id = a.poi_id"
        },
    ),
)
def site_route_access(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    stops = t.anchor(spark, d).withColumnRenamed("poi_id", "node_id")
    access = baseline.route_access(
        sites, stops, t.route(spark, d), bus_type("route_name"), BUS_TYPES, radius_m=1000
    )
    return access.drop("lat", "lng")


@query(
    "stop_route_sets",
    with_ctes(
        "anchor route",
        """SELECT poi_id AS node_id, len(r) AS n_routes, array_to_string(r, ',') AS routes
        FROM anchor JOIN (SELECT node_id, list_sort(list(DISTINCT route_name)) AS r FROM route GROUP BY 1)
        ON node_id = poi_id""",
    ),
)
def stop_route_sets(spark, d):
    stops = t.anchor(spark, d).select(F.col("poi_id").alias("node_id"))
    sets = baseline.stop_routes(stops, t.route(spark, d)).where("routes is not null")
    return sets.select(
        "node_id",
        F.size("routes").cast("long").alias("n_routes"),
        F.array_join("routes", ",").alias("routes"),
    )


@query(
    "weighted_camera_counts",
    with_ctes(
        "site camera",
        f"""SELECT s.site_id, coalesce(CAST(round_even(sum(w) FILTER (d<=300),0) AS BIGINT),0) AS camera_count_300m,
        coalesce(CAST(round_even(sum(w),0) AS BIGINT),0) AS camera_count_500m,
        coalesce(CAST(sum(n) FILTER (d<=300) AS BIGINT),0) AS point_count_300m,
        coalesce(CAST(sum(n) AS BIGINT),0) AS point_count_500m
        FROM site s LEFT JOIN (SELECT s.site_id, p.w, p.n, {sql_metres('s', 'p')} AS d
          FROM site s, place p WHERE {sql_metres('s', 'p')} <= 500) USING (site_id) GROUP BY 1""",
        {
            "pole": "SELECT agency, lat, lng, count(*) AS n, max(cameras) AS c FROM camera GROUP BY 1,2,3",
            "ag": "SELECT agency, max(c)<=1 AND sum(n)/count(*) < 1.2e0 AS unfilled, "
            "sum(greatest(n,c))/count(*) AS per_pole FROM pole GROUP BY 1",
            "place": "SELECT lat, lng, sum(n) AS n, greatest(sum(n)::DOUBLE, max(CASE WHEN unfilled THEN "
            "(SELECT coalesce(median(per_pole),1) FROM ag WHERE NOT unfilled) ELSE c END)) AS w "
            "FROM pole JOIN ag USING (agency) GROUP BY 1,2",
        },
    ),
)
def weighted_camera_counts(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    return cameras.weighted_camera_counts(sites, t.camera(spark, d)).drop("lat", "lng")


_SQL_MIDRANK = """SELECT {cols}, round_even(p*100,0)/100e0 AS pct, round_even((100-p)*100,0)/100e0 AS score
  FROM (SELECT *, ({better} + 0.5e0*ties)/n*100 AS p FROM (SELECT *,
  rank() OVER ({part} ORDER BY v) - 1 AS below, count(*) OVER ({both} v) AS ties,
  count(*) OVER ({part}) AS n FROM base))"""


@query(
    "midrank_city",
    with_ctes(
        "site poi",
        _SQL_MIDRANK.format(
            cols="site_id, v AS count_1000m", better="n-below-ties", part="", both="PARTITION BY"
        ),
        {
            **_PAIRS,
            "base": "SELECT s.site_id, count(d) FILTER (d<=1000) AS v FROM site s LEFT JOIN pair USING (site_id) GROUP BY 1",
        },
    ),
)
def midrank_city(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    counts = baseline.radius_counts(sites, t.poi(spark, d), [1000])
    return scoring.mid_rank(counts, "count_1000m", "higher").select(
        "site_id", "count_1000m", "pct", "score"
    )


@query(
    "midrank_gu",
    with_ctes(
        "site poi",
        _SQL_MIDRANK.format(
            cols="site_id, gu, v AS distance_m",
            better="below",
            part="PARTITION BY gu",
            both="PARTITION BY gu,",
        ),
        {**_PAIRS, "base": "SELECT site_id, gu, min(d) AS v FROM site JOIN pair USING (site_id) GROUP BY 1,2"},
    ),
)
def midrank_gu(spark, d):
    sites = t.site(spark, d)
    near = radius.nearest(sites, t.poi(spark, d)).select("site_id", "distance_m")
    scored = scoring.mid_rank(
        sites.select("site_id", "gu").join(near, "site_id"), "distance_m", "lower", ("gu",)
    )
    return scored.select("site_id", "gu", "distance_m", "pct", "score")


@query(
    "midrank_continuous",
    _SQL_MIDRANK.format(
        cols="c_custkey, v AS c_acctbal", better="n-below-ties", part="", both="PARTITION BY"
    ).replace("FROM base", "FROM (SELECT c_custkey, c_acctbal AS v FROM customer)"),
)
def midrank_continuous(spark, d):
    customers = t.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return scoring.mid_rank(customers, "c_acctbal", "higher")


@query(
    "probe_top_percent",
    with_ctes(
        "site",
        """SELECT gu, probe, CAST(greatest(1, round_even((count(*) FILTER (households > probe)
        + 0.5e0*count(*) FILTER (households = probe))/count(*)*100, 0)) AS INT) AS top_percent
        FROM site, (VALUES (60), (500), (1000), (2049)) v(probe) GROUP BY 1,2""",
    ),
)
def probe_top_percent(spark, d):
    sites = t.site(spark, d).select("gu", "households")
    probes = sites.select("gu").distinct().select(
        "gu", F.explode(F.array(*[F.lit(v) for v in (60, 500, 1000, 2049)])).alias("probe")
    )
    return scoring.probe_top_percent(sites, "households", probes, "higher", ("gu",))


@query(
    "legacy_percentile",
    with_ctes(
        "site",
        """SELECT site_id, households, round_even(100 - (rank() OVER (ORDER BY households)-1)
        / (count(*) OVER ())::DOUBLE * 100, 0) AS legacy_pct FROM site""",
    ),
)
def legacy_percentile(spark, d):
    return scoring.strict_percentile(t.site(spark, d).select("site_id", "households"), "households")


@query(
    "quantile_breaks",
    with_ctes(
        "site",
        """SELECT CAST(k AS INT) AS step, CAST(v[CAST(least(len(v)-1, round_even((len(v)-1)*k/100e0,0)) AS BIGINT)+1] AS DOUBLE)
        AS value FROM (SELECT list_sort(list(households)) AS v FROM site), range(0,101) r(k)""",
    ),
)
def quantile_breaks(spark, d):
    return scoring.break_table(t.site(spark, d).select(F.col("households").alias("value")))


@query(
    "percentile_of_breaks",
    with_ctes(
        "site",
        """SELECT site_id, CASE WHEN households <= b[1] THEN 0 WHEN households >= b[101] THEN 100
        ELSE len(list_filter(b, lambda x: x <= households)) - 1 END AS percentile FROM site, brk""",
        {
            "brk": "SELECT list(v[CAST(least(len(v)-1, round_even((len(v)-1)*k/100e0,0)) AS BIGINT)+1] ORDER BY k) AS b "
            "FROM (SELECT list_sort(list(households)) AS v FROM site), range(0,101) r(k)"
        },
    ),
)
def percentile_of_breaks(spark, d):
    sites = t.site(spark, d).select("site_id", "households")
    cuts = scoring.breaks(sites.select(F.col("households").alias("value")))
    return sites.select(
        "site_id", scoring.percentile_of("households", cuts).cast("long").alias("percentile")
    )


@query(
    "display_items",
    with_ctes(
        "site poi",
        """SELECT s.site_id, coalesce(string_agg(part || ':' || poi_id || ':' || d, '|' ORDER BY d, part, poi_id), '') AS items FROM site s LEFT JOIN (
        SELECT *, CASE layer WHEN 'hospital' THEN 0 WHEN 'subway' THEN 1 ELSE 2 END AS part FROM pair
        WHERE (layer = 'hospital' AND raw <= 500) OR (layer = 'subway' AND raw <= 3000) OR (layer = 'cafe' AND raw <= 1000)
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, part, poi_id) <= 12) USING (site_id) GROUP BY 1""",
        {"pair": f"SELECT s.site_id, p.poi_id, p.layer, {sql_metres('s', 'p')} AS d, {sql_raw_metres('s', 'p')} AS raw FROM site s, poi p"},
    ),
)
def display_items(spark, d):
    """Three layers in one list, each within its own radius."""
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    poi = t.poi(spark, d)
    parts = [(poi.where(F.col("layer") == x), r) for x, r in (("hospital", 500), ("subway", 3000), ("cafe", 1000))]
    text = F.transform("items", lambda x: F.concat_ws(":", x["part"], x["poi_id"], x["distance"]))
    listed = baseline.display_items(sites, parts, 12)
    return listed.select("site_id", F.coalesce(F.array_join(text, "|"), F.lit("")).alias("items"))


@query(
    "category_baseline",
    with_ctes(
        "site poi",
        _SQL_MIDRANK.format(
            cols="site_id, n5 AS academy_count_500m, v AS academy_count_1000m, near AS nearest_distance, items", better="n-below-ties", part="", both="PARTITION BY"
        ),
        {
            **_PAIRS,
            "base": "SELECT s.site_id, count(d) FILTER (d<=500) AS n5, count(d) AS v, min(d) AS near, count(d) AS items FROM site s "
            "LEFT JOIN (SELECT * FROM pair WHERE layer='academy' AND d<=1000) USING (site_id) GROUP BY 1",
        },
    ),
)
def category_baseline(spark, d):
    """The whole chain of one category job."""
    sites = t.site(spark, d).select("site_id", "name", "gu", "dong", "lat", "lng")
    table = jobs.category_baseline(sites, t.poi(spark, d).where("layer = 'academy'"), CATEGORIES["academy"])
    return table.select(
        "site_id", "academy_count_500m", "academy_count_1000m", "nearest_distance",
        F.json_array_length("items_json").cast("long").alias("items"),
        F.col("academy_count_1000m_pct").alias("pct"), F.col("academy_count_1000m_score").alias("score"),
    )


@query(
    "complex_info",
    """SELECT o_orderkey, '60㎡ 이하 ' || format('{:,}', o_orderkey % 3000) || '세대 / 60~85㎡ ' || format('{:,}', o_custkey) || '세대 / 85~135㎡ 0세대 / 135㎡ 초과 0세대' AS mix,
    CASE WHEN o_custkey % 4 > 0 AND o_orderkey % 500 > 0 THEN round_even((o_orderkey % 500)::DOUBLE / nullif(o_custkey % 4 * 100, 0) * 100, 0) / 100e0 END AS parking FROM orders""",
)
def complex_info(spark, d):
    """Area mix text and parking places per household."""
    rows = t.read(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 3000 AS a", "o_custkey AS b", "0 AS c", "cast(null as int) AS e",
        "o_orderkey % 500 AS p", "nullif(o_custkey % 4 * 100, 0) AS h",
    )
    return rows.select(
        "o_orderkey", display.area_mix_text(["a", "b", "c", "e"]).alias("mix"), display.parking_per_household("p", "h").alias("parking")
    )
