"""Queries on the grid: building it, reading it, and its connected areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import bbox_cells, half_even
from ..operators import graph, grid, polygons
from ..session import scratch_dir
from . import jobs, tables as t
from .registry import query
from .tables import GRID_CTES, SQL_CI, SQL_CJ, with_ctes

_BUILT: dict[tuple[str, str], grid.Grid] = {}
BOX = (37.50, 126.90, 37.56, 126.99)
_I0, _I1, _J0, _J1 = bbox_cells(*BOX)


def layered(spark, d):
    """Pois with the radius of their layer."""
    radius = F.create_map(*[F.lit(x) for kv in t.LAYER_RADIUS.items() for x in kv])
    return t.poi(spark, d).withColumn("radius_m", F.element_at(radius, F.col("layer")))


def built(spark, d) -> grid.Grid:
    """The written grid of a scale folder; built once per application, as a batch job would."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        path = f"{scratch_dir(spark)}/grid-{key[0]}-{d.strip('/').replace('/', '-')}"
        _BUILT[key] = jobs.build_grid(
            t.site(spark, d), layered(spark, d), t.LAYER_RADIUS, t.district_edges(spark), path,
        )
    return _BUILT[key]


@query(
    "cell_sites",
    with_ctes("site member", "SELECT i, j, site_id, in_core FROM member"),
)
def cell_sites(spark, d):
    return grid.cell_sites(t.site(spark, d)).select("i", "j", "site_id", "in_core")


@query("zone", with_ctes(GRID_CTES, "SELECT * FROM zone"))
def zone(spark, d):
    members = grid.cell_sites(t.site(spark, d))
    districts = polygons.rasterize(t.district_edges(spark))
    border = graph.border_distance(districts, jobs.region_box())
    return grid.zone_cells(members, districts, border)


@query(
    "rasterize_districts",
    with_ctes(GRID_CTES, "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, polygon FROM raster SEMI JOIN zone USING (i, j)"),
)
def rasterize_districts(spark, d):
    return polygons.rasterize(t.district_edges(spark), grid.cell_sites(t.site(spark, d)))


@query(
    "border_distance",
    with_ctes(GRID_CTES, "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, border_m FROM border SEMI JOIN zone USING (i, j)"),
)
def border_distance(spark, d):
    inside = polygons.rasterize(t.district_edges(spark))
    cells = grid.cell_sites(t.site(spark, d)).select("i", "j").distinct()
    return graph.border_distance(inside, jobs.region_box()).join(cells, ["i", "j"], "left_semi")


@query("cell_point_counts", with_ctes(GRID_CTES + " cellcount", "SELECT * FROM cellcount"))
def cell_point_counts(spark, d):
    return grid.point_counts(t.poi(spark, d), built(spark, d).zone)


@query("cell_coverage", with_ctes(GRID_CTES + " cov", "SELECT * FROM cov"))
def cell_coverage(spark, d):
    return grid.coverage(layered(spark, d), built(spark, d).zone)


@query("cell_households", with_ctes(GRID_CTES + " hh", "SELECT * FROM hh"))
def cell_households(spark, d):
    return grid.household_coverage(t.site(spark, d), built(spark, d).zone, (300, 500, 1000))


@query("cell_nearest", with_ctes(GRID_CTES + " near", "SELECT * FROM near"))
def cell_nearest(spark, d):
    return grid.cell_nearest(built(spark, d).zone, t.poi(spark, d), ["hospital", "subway"])


def _values_sql(layer, mode, factor, subtypes=None, core=False, edge=False, per_hh=False, bounds=False):
    table, column, inner, outer = {
        "coverage": ("cov", "count", "sum", "avg"), "point": ("cellcount", "count", "sum", "sum"),
        "nearest": ("near", "distance_m", "min", "min"),
    }[mode]
    radius = t.LAYER_RADIUS[layer]
    where = [f"layer = '{layer}'"]
    if subtypes:
        where.append("subtype IN (" + ",".join(f"'{s}'" for s in subtypes) + ")")
    if core:
        where.append("(i, j) IN (SELECT (i, j) FROM zone WHERE in_core)")
    if edge:
        where.append(f"(i, j) IN (SELECT (i, j) FROM zone WHERE border_m >= {radius})")
    if bounds:
        where.append(f"i BETWEEN {_I0} AND {_I1} AND j BETWEEN {_J0} AND {_J1}")
    inner_sql = f"SELECT i, j, {inner}({column}) AS v FROM {table} WHERE {' AND '.join(where)} GROUP BY 1, 2"
    if per_hh:
        inner_sql = (
            f"SELECT i, j, v * 1000e0 / households AS v FROM ({inner_sql}) JOIN hh USING (i, j) "
            f"WHERE radius_m = {radius} AND households >= 200"
        )
    return (
        f"SELECT CAST(floor(i / {factor}e0) AS INT) AS gi, CAST(floor(j / {factor}e0) AS INT) AS gj, "
        f"CAST({outer}(v) AS DOUBLE) AS value FROM ({inner_sql}) GROUP BY 1, 2"
    )


def _breaks_sql(layer, mode, factor=1, fill=True, **selection):
    """The 101 breaks as a list, zero-filled to the safe zone."""
    radius = t.LAYER_RADIUS[layer]
    core = " AND in_core" if selection.get("core") else ""
    total = (
        f"(SELECT count(*) FROM (SELECT DISTINCT floor(i / {factor}e0), floor(j / {factor}e0) "
        f"FROM zone WHERE border_m >= {radius}{core}))"
    )
    values = f"SELECT value AS v FROM ({_values_sql(layer, mode, factor, edge=True, **selection)})"
    zeros = (
        f" UNION ALL SELECT 0e0 FROM range(0, greatest(0, {total} - (SELECT count(*) FROM ({values})))) z"
        if fill else ""
    )
    return (
        "SELECT list(round_even(s[CAST(least(len(s) - 1, round_even((len(s) - 1) * k / 100e0, 0)) AS BIGINT) + 1] * 100, 0) / 100e0 "
        f"ORDER BY k) AS b FROM (SELECT list_sort(list(v)) AS s FROM ({values}{zeros})), range(0, 101) r(k)"
    )


def _percentile_sql(value, breaks):
    return (
        f"CASE WHEN {value} <= {breaks}[1] THEN 0 WHEN {value} >= {breaks}[101] THEN 100 "
        f"ELSE CAST(len(list_filter({breaks}, lambda x: x <= {value})) - 1 AS INT) END"
    )


_ROUND = "SELECT gi, gj, round_even(value * 1000, 0) / 1000e0 AS value FROM "


def _rounded(df):
    return df.withColumn("value", half_even("value", 3))


@query("coarsen_1", with_ctes(GRID_CTES + " cov", _ROUND + f"({_values_sql('academy', 'coverage', 1)})"))
def coarsen_1(spark, d):
    return _rounded(grid.cell_values(built(spark, d), "academy", "coverage"))


@query(
    "coarsen_3",
    with_ctes(GRID_CTES + " cov", _ROUND + f"({_values_sql('academy', 'coverage', 3, subtypes=['ECONOMY', 'PROMO'], core=True)})"),
)
def coarsen_3(spark, d):
    return _rounded(
        grid.cell_values(built(spark, d), "academy", "coverage", 3, ["ECONOMY", "PROMO"], core_only=True)
    )


@query("coarsen_9", with_ctes(GRID_CTES + " cellcount", _ROUND + f"({_values_sql('cafe', 'point', 9, edge=True)})"))
def coarsen_9(spark, d):
    return _rounded(grid.cell_values(built(spark, d), "cafe", "point", 9, exclude_edge=True))


@query("coarsen_nearest", with_ctes(GRID_CTES + " near", _ROUND + f"({_values_sql('subway', 'nearest', 3)})"))
def coarsen_nearest(spark, d):
    return _rounded(grid.cell_values(built(spark, d), "subway", "nearest", 3))


@query(
    "per_1000_households",
    with_ctes(GRID_CTES + " cov hh", _ROUND + f"({_values_sql('hospital', 'coverage', 1, per_hh=True)})"),
)
def per_1000_households(spark, d):
    return _rounded(grid.cell_values(built(spark, d), "hospital", "coverage", per_households=True))


@query(
    "zone_cell_count",
    with_ctes(
        GRID_CTES,
        "SELECT 3 AS factor, count(DISTINCT (floor(i/3e0), floor(j/3e0))) AS cells FROM zone WHERE in_core AND border_m >= 500",
    ),
)
def zone_cell_count(spark, d):
    return grid.zone_count(built(spark, d), 3, True, 500).select(F.lit(3).alias("factor"), "cells")


@query(
    "grid_scale",
    with_ctes(
        GRID_CTES + " cov",
        "SELECT CAST(k AS INT) AS step, b[k + 1] AS value FROM brk, range(0, 101) r(k)",
        {"brk": _breaks_sql("hospital", "coverage")},
    ),
)
def grid_scale(spark, d):
    return grid.scale_table(built(spark, d), "hospital", "coverage")


@query(
    "grid_scale_nearest",
    with_ctes(
        GRID_CTES + " near",
        "SELECT CAST(k AS INT) AS step, b[k + 1] AS value FROM brk, range(0, 101) r(k)",
        {"brk": _breaks_sql("subway", "nearest", 3, fill=False)},
    ),
)
def grid_scale_nearest(spark, d):
    return grid.scale_table(built(spark, d), "subway", "nearest", 3)


def _compare_sql(a, b, factor=1, edge=False, bounds=False):
    pick = lambda layer: _values_sql(layer, "coverage", factor, edge=edge, bounds=bounds)
    return (
        f"SELECT gi, gj, {_percentile_sql('va', 'ba')} - {_percentile_sql('vb', 'bb')} AS diff, "
        f"{_percentile_sql('va', 'ba')} AS pa, {_percentile_sql('vb', 'bb')} AS pb FROM ("
        f"SELECT gi, gj, coalesce(x.value, 0) AS va, coalesce(y.value, 0) AS vb FROM ({pick(a)}) x "
        f"FULL JOIN ({pick(b)}) y USING (gi, gj)), (SELECT b AS ba FROM brk_a), (SELECT b AS bb FROM brk_b)"
    )


def _two_breaks(a, b, factor=1):
    return {"brk_a": _breaks_sql(a, "coverage", factor), "brk_b": _breaks_sql(b, "coverage", factor)}


@query(
    "layer_compare",
    with_ctes(GRID_CTES + " cov", _compare_sql("academy", "hospital", 3, bounds=True), _two_breaks("academy", "hospital", 3)),
)
def layer_compare(spark, d):
    return grid.compare_layers(built(spark, d), "academy", "hospital", 3, bounds=BOX)


def _flagged(spark, d):
    """Cells that at least two hospitals reach."""
    return grid.cell_values(built(spark, d), "hospital", "coverage").where("value >= 2").select(
        F.col("gi").alias("i"), F.col("gj").alias("j")
    )


_STEPS = "SELECT i + 1 AS i, j, cid FROM label UNION ALL SELECT i - 1, j, cid FROM label UNION ALL SELECT i, j + 1, cid FROM label UNION ALL SELECT i, j - 1, cid FROM label"


def _components_sql(ctes: str, flagged: str, extra: dict[str, str], body: str) -> str:
    """Smallest labels spread cell by cell until nothing changes."""
    start = "SELECT i, j, (CAST(i AS BIGINT) << 31) + j + 1073741824 AS cid FROM flagged"
    spread = (
        f"SELECT n.i, n.j, min(n.cid) AS cid FROM ({_STEPS}) n JOIN recurring.label o ON o.i = n.i AND o.j = n.j "
        "WHERE n.cid < o.cid GROUP BY n.i, n.j"
    )
    text = with_ctes(ctes, body, {**extra, "flagged": flagged, "label(i, j, cid) USING KEY (i, j)": f"{start} UNION {spread}"})
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "components",
    _components_sql(
        GRID_CTES + " cov", f"SELECT gi AS i, gj AS j FROM ({_values_sql('hospital', 'coverage', 1)}) WHERE value >= 2", {},
        "SELECT i, j, cid FROM label",
    ),
)
def components(spark, d):
    return graph.components(_flagged(spark, d))


def _described_sql(stats: str, min_cells: int) -> str:
    return f"""SELECT cid, count(*) AS cells, round_even(count(*) * 0.01e0 * 1000, 0) / 1000e0 AS area_km2, {stats},
    round_even((37.4e0 + min(i) * (100e0 / 111000e0)) * 1e6, 0) / 1e6 AS min_lat, round_even((37.4e0 + (max(i) + 1) * (100e0 / 111000e0)) * 1e6, 0) / 1e6 AS max_lat,
    round_even((126.75e0 + min(j) * (100e0 / 88800e0)) * 1e6, 0) / 1e6 AS min_lng, round_even((126.75e0 + (max(j) + 1) * (100e0 / 88800e0)) * 1e6, 0) / 1e6 AS max_lng
    FROM label JOIN flagged USING (i, j) GROUP BY 1 HAVING count(*) >= {min_cells}"""


def _places_sql(rows: str, weight: str) -> str:
    return f"""SELECT cid, string_agg(gu || ':' || dong || ':' || n, '|' ORDER BY rn) AS places FROM (
    SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, gu, dong) AS rn FROM (SELECT cid, gu, dong, CAST({weight} AS BIGINT) AS n FROM ({rows}) GROUP BY 1, 2, 3)) WHERE rn <= 3 GROUP BY 1"""


_INSIDE = "SELECT DISTINCT cid, site_id, gu, dong FROM label JOIN member USING (i, j)"
_LIVING = f"SELECT l.cid, s.site_id, s.gu, s.dong, s.households FROM label l JOIN (SELECT *, {SQL_CI} AS i, {SQL_CJ} AS j FROM site) s USING (i, j)"


@query(
    "imbalance_clusters",
    _components_sql(
        GRID_CTES + " cov",
        f"SELECT CAST(gi AS INT) AS i, CAST(gj AS INT) AS j, diff FROM ({_compare_sql('academy', 'hospital', edge=True)}) "
        "WHERE diff >= 30 AND (gi, gj) IN (SELECT (i, j) FROM zone WHERE border_m >= 1000)",
        _two_breaks("academy", "hospital"),
        f"""SELECT d.*, coalesce(n, 0) AS site_count, places FROM ({_described_sql('round_even(avg(diff) * 10, 0) / 10e0 AS mean_diff, max(diff) AS max_diff', 5)}) d
        LEFT JOIN (SELECT cid, count(*) AS n FROM ({_INSIDE}) GROUP BY 1) USING (cid) LEFT JOIN ({_places_sql(_INSIDE, 'count(*)')}) USING (cid)
        ORDER BY cells DESC, cid LIMIT 40""",
    ),
)
def imbalance_clusters(spark, d):
    found = grid.imbalance_clusters(built(spark, d), "academy", "hospital", threshold=30, min_cells=5)
    return found.withColumns({c: half_even(c, 6) for c in ("min_lat", "max_lat", "min_lng", "max_lng")})


_GAP_SQL = f"""SELECT i, j, coalesce(distance_m, 3000) AS distance_m FROM (
  SELECT gi AS i, gj AS j FROM ({_values_sql('bus_stop', 'coverage', 1, edge=True)}), brk WHERE value >= b[51])
  LEFT JOIN (SELECT * FROM near WHERE layer = 'subway') USING (i, j) WHERE coalesce(distance_m, 3000) > 800
  AND (i, j) NOT IN (SELECT (i, j) FROM cov WHERE layer = 'bus_stop' AND subtype = 'PROMO')"""


@query(
    "transit_gap",
    _components_sql(
        GRID_CTES + " cov near", _GAP_SQL, {"brk": _breaks_sql("bus_stop", "coverage")},
        f"""SELECT *, CAST(sum(households) OVER () AS BIGINT) AS total_households, CAST(sum(site_count) OVER () AS BIGINT) AS total_sites,
        round_even(sum(area_km2) OVER () * 10, 0) / 10e0 AS total_area_km2, count(*) OVER () AS cluster_count FROM (
        SELECT d.*, coalesce(h, 0) AS households, coalesce(n, 0) AS site_count, places FROM (
        {_described_sql('max(distance_m) AS max_distance_m, list_sort(list(distance_m))[count(*) // 2 + 1] AS median_distance_m', 5)}) d
        LEFT JOIN (SELECT cid, CAST(sum(households) AS BIGINT) AS h, count(*) AS n FROM ({_LIVING}) GROUP BY 1) USING (cid)
        LEFT JOIN ({_places_sql(_LIVING, 'sum(households)')}) USING (cid)) ORDER BY households DESC, cid LIMIT 30""",
    ),
)
def transit_gap(spark, d):
    found = grid.transit_gap(
        built(spark, d), min_cells=5, min_distance_m=800, bus_percentile=50, corridor="PROMO",
    )
    return found.withColumns({c: half_even(c, 6) for c in ("min_lat", "max_lat", "min_lng", "max_lng")})


@query(
    "transit_gap_cells",
    with_ctes(
        GRID_CTES + " cov near",
        f"""SELECT i, j, coalesce(distance_m, 3000) AS distance_m FROM (
        SELECT gi AS i, gj AS j FROM ({_values_sql('bus_stop', 'coverage', 1, edge=True)}), brk WHERE value >= b[51])
        LEFT JOIN (SELECT * FROM near WHERE layer = 'subway') USING (i, j)
        WHERE coalesce(distance_m, 3000) > 800
        AND (i, j) NOT IN (SELECT (i, j) FROM cov WHERE layer = 'bus_stop' AND subtype = 'PROMO')""",
        {"brk": _breaks_sql("bus_stop", "coverage")},
    ),
)
def transit_gap_cells(spark, d):
    return grid.transit_gap_cells(built(spark, d), corridor="PROMO").select("i", "j", "distance_m")


@query(
    "viewport_cells",
    with_ctes(
        GRID_CTES + " cov",
        f"""SELECT gi, gj, round_even(value * 100, 0) / 100e0 AS value, coalesce(edge, 0) AS edge
        FROM ({_values_sql('academy', 'coverage', 1, bounds=True)}) LEFT JOIN (
        SELECT i AS gi, j AS gj, 1 AS edge FROM zone WHERE border_m < 1000) USING (gi, gj)
        ORDER BY gi, gj LIMIT 20001""",
    ),
)
def viewport_cells(spark, d):
    return grid.viewport_cells(built(spark, d), "academy", "coverage", BOX)


@query(
    "viewport_points",
    with_ctes(
        GRID_CTES + " cellcount",
        f"""SELECT round_even(lat * 1e6, 0) / 1e6 AS lat, round_even(lng * 1e6, 0) / 1e6 AS lng, subtype, count FROM (
        SELECT *, {t.SQL_CLAT} AS lat, {t.SQL_CLNG} AS lng FROM cellcount WHERE layer = 'cafe'
        AND i BETWEEN {_I0} AND {_I1} AND j BETWEEN {_J0} AND {_J1} ORDER BY i, j, subtype LIMIT 2001)""",
    ),
)
def viewport_points(spark, d):
    points = grid.viewport_points(built(spark, d), "cafe", BOX)
    return points.withColumns({"lat": half_even("lat", 6), "lng": half_even("lng", 6)})


#: From the one cell outwards: its sites, its places, and the district it lies in.
_CELL_CTES = {
    "cell": f"SELECT {SQL_CI} AS i, {SQL_CJ} AS j FROM (SELECT 37.5501e0 AS lat, 126.9502e0 AS lng)",
    "own": f"SELECT *, d2 <= 250000e0 AS in_core FROM (SELECT s.*, i, j, {t.SQL_D2} AS d2 FROM site s, cell) WHERE d2 <= 1000000e0",
    "beside": f"SELECT layer, subtype, r, {t.SQL_D2} AS d2 FROM (SELECT p.*, {t._RADIUS_CASE} AS r, i, j FROM poi p, cell) WHERE EXISTS (SELECT 1 FROM own)",
}


@query(
    "cell_detail",
    with_ctes(
        "site poi district_edge raster",
        """SELECT 'coverage' AS part, layer AS key, subtype AS detail, count(*) AS n FROM beside WHERE d2 <= CAST(r AS DOUBLE) * r GROUP BY layer, subtype
        UNION ALL SELECT 'nearest', layer, '', CAST(round_even(sqrt(min(d2)), 0) AS INT) FROM beside WHERE layer IN ('hospital', 'subway') AND d2 <= 9000000 GROUP BY layer
        UNION ALL SELECT 'zone', coalesce((SELECT polygon FROM raster SEMI JOIN cell USING (i, j)), first(gu ORDER BY d2, site_id)), first(dong ORDER BY d2, site_id), count(*)
        FROM own HAVING count(*) > 0
        UNION ALL SELECT 'site', name, in_core::VARCHAR, site_id FROM (SELECT * FROM own ORDER BY in_core DESC, name LIMIT 60)""",
        _CELL_CTES,
    ),
)
def cell_detail(spark, d):
    i, _, j, _ = bbox_cells(37.5501, 126.9502, 37.5501, 126.9502)
    parts = grid.cell_detail(built(spark, d), i, j)
    row = lambda df, part, key, detail, n: df.select(
        F.lit(part).alias("part"), F.col(key).alias("key"), detail.cast("string").alias("detail"),
        F.col(n).cast("long").alias("n"),
    )
    return (
        row(parts["coverage"], "coverage", "layer", F.col("subtype"), "count")
        .unionByName(row(parts["nearest"], "nearest", "layer", F.lit(""), "distance_m"))
        .unionByName(row(parts["zone"], "zone", "gu", F.col("dong"), "site_count"))
        .unionByName(row(parts["sites"], "site", "name", F.col("in_core"), "site_id"))
    )


@query(
    "layer_meta",
    with_ctes(
        GRID_CTES + " cov near",
        "SELECT layer, radius_m, coalesce(n, 0) AS poi_count, subtypes, has IS NOT NULL AS has_nearest FROM (VALUES "
        + ", ".join(f"('{k}', {v})" for k, v in t.LAYER_RADIUS.items())
        + """) r(layer, radius_m) LEFT JOIN (SELECT layer, count(*) AS n FROM poi GROUP BY 1) USING (layer)
        LEFT JOIN (SELECT layer, string_agg(DISTINCT subtype, ',' ORDER BY subtype) AS subtypes FROM cov GROUP BY 1) USING (layer)
        LEFT JOIN (SELECT DISTINCT layer, 1 AS has FROM near) USING (layer)""",
    ),
)
def layer_meta(spark, d):
    registry = spark.createDataFrame(list(t.LAYER_RADIUS.items()), "layer string, radius_m int")
    return grid.layer_meta(built(spark, d), registry, t.poi(spark, d))


@query(
    "district_labels",
    with_ctes(
        GRID_CTES,
        """SELECT gu, count(*) AS cells, round_even((37.4e0 + (avg(i) + 0.5e0) * (100e0 / 111000e0)) * 1e6, 0) / 1e6 AS lat,
        round_even((126.75e0 + (avg(j) + 0.5e0) * (100e0 / 88800e0)) * 1e6, 0) / 1e6 AS lng FROM zone GROUP BY 1""",
    ),
)
def district_labels(spark, d):
    labels = grid.label_positions(built(spark, d))
    return labels.withColumns({"lat": half_even("lat", 6), "lng": half_even("lng", 6)})


@query(
    "layer_correlation",
    with_ctes(
        GRID_CTES + " cov",
        """SELECT a.layer AS layer_a, b.layer AS layer_b, round_even(corr(a.r, b.r) * 1000, 0) / 1000e0 AS rho
        FROM ranked a JOIN ranked b USING (i, j) WHERE a.k < b.k GROUP BY 1, 2""",
        {
            "ranked": """SELECT i, j, layer, k, rank() OVER (PARTITION BY layer ORDER BY v) - 1
            + (count(*) OVER (PARTITION BY layer, v) + 1) / 2e0 AS r FROM (
            SELECT z.i, z.j, l.layer, l.k, coalesce(sum(c.count), 0) AS v FROM zone z, (VALUES """
            + ", ".join(f"('{name}', {k})" for k, name in enumerate(t.LAYERS))
            + """) l(layer, k) LEFT JOIN cov c ON c.i = z.i AND c.j = z.j AND c.layer = l.layer GROUP BY 1, 2, 3, 4)"""
        },
    ),
)
def layer_correlation(spark, d):
    return grid.layer_correlation(built(spark, d), t.LAYERS)


@query(
    "point_in_polygon",
    with_ctes(
        "site zone_edge",
        """SELECT s.site_id, z.zone, coalesce(z.shared_zones, '') AS shared_zones, coalesce(z.match_count, 0) AS match_count,
        coalesce(z.shared_count, 0) AS shared_count FROM site s LEFT JOIN (
        SELECT site_id, first(polygon ORDER BY shared, ord) AS zone, count(*) AS match_count,
        count(*) FILTER (shared) AS shared_count,
        coalesce(string_agg(polygon, '|' ORDER BY ord) FILTER (shared), '') AS shared_zones FROM (
        SELECT site_id, polygon, shared, ord FROM site JOIN zone_edge
        ON ((lat1 <= lat AND lat < lat2) OR (lat2 <= lat AND lat < lat1))
        AND lng1 + (lat - lat1) / (lat2 - lat1) * (lng2 - lng1) > lng
        GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1) z USING (site_id)""",
    ),
)
def point_in_polygon(spark, d):
    sites = t.site(spark, d).select("site_id", "lat", "lng")
    located = polygons.primary_zone(polygons.points_in_polygons(sites, t.zone_edges(spark)))
    return located.drop("lat", "lng")
