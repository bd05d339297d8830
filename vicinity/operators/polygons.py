"""Polygons as edge rows: point-in-polygon and rasterising, both by counting edge crossings.

``edges``: ``polygon, ord, lat1, lng1, lat2, lng2`` (closed rings, holes included; the even-odd
rule treats a hole as another crossing). Rings are whole: edges along a parallel belong to them.

For points, every polygon is cut into square tiles of its own size, about as many along a side as
half the root of its number of edges. A tile that edges pass holds these edges and whether its
upper right corner is inside. A tile without edges is inside as a whole, or not kept at all. So a
point tests only the edges of its own tile, on a path from the point to the right side and up to
the corner, whatever the size of the polygon or of the map.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import D_LAT, D_LNG, LAT_ORIGIN, LNG_ORIGIN
from ..session import cut

#: Sides of tiles are powers of two of a degree, from 16 degrees down to 2**-20.
COARSEST, FINEST = -4, 20
#: Tiles begin beside the decimal places in which maps are drawn, so no corner lies on a border by rule.
_OFFSET = 3.14159265358979e-8
_RING = ("shared", "ord", "polygon")


def edges_of(polygons: DataFrame, *keep: str) -> DataFrame:
    """Edge rows from ``rings``: ``array<array<struct<lng, lat>>>``."""
    ring = polygons.select("polygon", "ord", *keep, F.explode("rings").alias("r"))
    pairs = F.transform(
        F.slice(F.col("r"), 1, F.size("r") - 1),
        lambda p, k: F.struct(p["lat"].alias("lat1"), p["lng"].alias("lng1"),
                              F.get(F.col("r"), k + 1)["lat"].alias("lat2"), F.get(F.col("r"), k + 1)["lng"].alias("lng2")),
    )
    out = ring.where(F.size("r") > 1).select("polygon", "ord", *keep, F.explode(pairs).alias("e"))
    return out.select("polygon", "ord", *keep, "e.*").where("lat1 <> lat2 OR lng1 <> lng2")


def _number(value: str, rounded: str = "floor") -> str:
    """Row or column of a latitude or longitude; ``side`` is the side of the tile."""
    return f"cast({rounded}(({value} + {_OFFSET!r}D) / side) AS long)"


def _begin(number: str) -> str:
    return f"({number} * side - {_OFFSET!r}D)"


def _sized(edges: DataFrame, widest: float | None) -> DataFrame:
    """Edges with the level of their polygon and the side of its tiles, at most ``widest`` degrees."""
    coarsest = COARSEST if widest is None else min(max(COARSEST, math.ceil(-math.log2(widest))), FINEST)
    extent = F.greatest(
        F.max(F.greatest("lat1", "lat2")) - F.min(F.least("lat1", "lat2")),
        F.max(F.greatest("lng1", "lng2")) - F.min(F.least("lng1", "lng2")),
    )
    shape = edges.groupBy(*_RING).agg(F.count("*").alias("_n"), extent.alias("_extent"))
    wanted = F.log2(F.greatest(F.sqrt("_n") / 2, F.lit(1.0)) / F.greatest("_extent", F.lit(1e-9)))
    level = F.least(F.greatest(F.floor(wanted), F.lit(coarsest)), F.lit(FINEST)).cast("int")
    shape = shape.select(*(F.col(c).alias(f"_{c}") for c in _RING), level.alias("level"), F.pow(F.lit(2.0), -level).alias("side"))
    same = [edges[c].eqNullSafe(shape[f"_{c}"]) for c in _RING]
    return edges.join(shape, same[0] & same[1] & same[2]).drop(*(f"_{c}" for c in _RING))


def _at(lat: str) -> str:
    """Where an edge that is not level meets a parallel."""
    return f"(lng1 + ({lat} - lat1) / (lat2 - lat1) * (lng2 - lng1))"


def tiles_of(edges: DataFrame, widest: float | None = None) -> DataFrame:
    """``(level, row, col, zones)``: what each tile knows of the polygons that reach it.

    A zone has ``shared, ord, polygon``, ``inside`` (of the upper right corner) and the ``edges`` that pass the tile.
    """
    keys = [*_RING, "level"]
    edges = _sized(edges, widest).selectExpr("*", "least(lat1, lat2) AS low", "greatest(lat1, lat2) AS high")
    rows = edges.selectExpr("*", f"explode(sequence({_number('low')}, {_number('high')})) AS row")
    rows = rows.selectExpr("*", f"greatest(low, {_begin('row')}) AS _from", f"least(high, {_begin('(row + 1)')}) AS _to")
    ends = [f"if(lat1 = lat2, lng{k}, {_at(c)})" for k, c in ((1, "_from"), (2, "_to"))]
    rows = rows.selectExpr("*", f"least({ends[0]}, {ends[1]}) AS _left", f"greatest({ends[0]}, {ends[1]}) AS _right")
    passed = rows.selectExpr(*keys, "side", "row", f"explode(sequence({_number('_left - 1e-12D')}, {_number('_right + 1e-12D')})) AS col", "struct(lat1, lng1, lat2, lng2) AS e")
    held = passed.groupBy(*keys, "side", "row", "col").agg(F.collect_list("e").alias("edges"))
    # Crossings with the upper side's parallel that lie to the right of a corner, counted from the right.
    line = edges.selectExpr("*", f"explode(sequence({_number('low', 'ceil')}, {_number('high')})) AS _line").where("lat1 <> lat2")
    line = line.withColumn("_lat", F.expr(_begin("_line"))).where("(lat1 <= _lat AND _lat < lat2) OR (lat2 <= _lat AND _lat < lat1)")
    met = line.selectExpr(*keys, "_line - 1 AS row", f"{_at('_lat')} AS _x", "1 AS _one", "cast(NULL AS long) AS col", "side", "cast(NULL AS array<struct<lat1: double, lng1: double, lat2: double, lng2: double>>) AS edges")
    corners = held.selectExpr(*keys, "row", f"{_begin('(col + 1)')} AS _x", "0 AS _one", "col", "side", "edges")
    from_right = Window.partitionBy(*keys, "row").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, 0)
    known = met.unionByName(corners).withColumn("inside", F.sum("_one").over(from_right) % 2).where("col IS NOT NULL")
    known = known.select(*keys, "side", "row", "col", "inside", "edges")
    along = Window.partitionBy(*keys, "row").orderBy("col")
    gaps = known.withColumn("_next", F.lead("col").over(along)).where("inside = 1 AND _next > col + 1")
    whole = gaps.withColumn("col", F.explode(F.expr("sequence(col + 1, _next - 1)"))).withColumn("edges", F.expr("slice(edges, 1, 0)"))
    zone = F.struct(*_RING, "inside", "edges")
    every = known.unionByName(whole.drop("_next"))
    return every.groupBy("level", "row", "col").agg(F.array_sort(F.collect_list(zone)).alias("zones"))


def points_in_polygons(points: DataFrame, edges: DataFrame, strip_deg: float | None = None) -> DataFrame:
    """Every point with ``zones``: the polygons that contain it, normal ones first, then by order.

    ``edges`` also has ``shared`` (boolean). Points in no polygon, or without coordinates, get an empty array. Points meet
    one tile for each size of tile (at most ``FINEST - COARSEST + 1``) and are not multiplied. ``strip_deg`` is the widest
    that a tile may be.
    """
    tiles = cut(tiles_of(edges, strip_deg))
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())
    over = "e.lng1 + (lat - e.lat1) / (e.lat2 - e.lat1) * (e.lng2 - e.lng1)"
    beside = f"if((e.lat1 <= lat AND lat < e.lat2) OR (e.lat2 <= lat AND lat < e.lat1), lng < {over} AND {over} <= _right, false)"
    at_side = "e.lat1 + (_right - e.lng1) / (e.lng2 - e.lng1) * (e.lat2 - e.lat1)"
    above = f"if((e.lng1 <= _right) <> (e.lng2 <= _right), lat < {at_side} AND {at_side} <= _top, false)"
    crossed = f"size(filter(z.edges, e -> ({beside}) <> ({above})))"
    found = f"transform(filter(_zones, z -> (z.inside + {crossed}) % 2 = 1), z -> struct(z.shared AS shared, z.ord AS ord, z.polygon AS polygon))"
    none = "cast(array() AS array<struct<shared: boolean, ord: int, polygon: string>>)"
    out = points.withColumn("zones", F.expr(none))
    for level in levels:
        own = tiles.where(F.col("level") == level).select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("zones").alias("_zones"))
        placed = out.withColumn("side", F.lit(2.0**-level)).selectExpr("*", f"{_number('lat')} AS _row", f"{_number('lng')} AS _col")
        placed = placed.selectExpr("*", f"{_begin('(_row + 1)')} AS _top", f"{_begin('(_col + 1)')} AS _right")
        met = placed.join(own, ["_row", "_col"], "left").withColumn("zones", F.concat("zones", F.coalesce(F.expr(found), F.expr(none))))
        out = met.select(*points.columns, "zones")
    return out.withColumn("zones", F.array_sort("zones"))


def primary_zone(located: DataFrame) -> DataFrame:
    """The first zone, the shared zone names, and how many of each kind matched."""
    shared = F.filter("zones", lambda z: z["shared"])
    return located.withColumns(
        {
            "zone": F.try_element_at("zones", F.lit(1))["polygon"],
            "shared_zones": F.array_join(F.transform(shared, lambda z: z["polygon"]), "|"),
            "match_count": F.size("zones").cast("long"),
            "shared_count": F.size(shared).cast("long"),
        }
    ).drop("zones")


def rasterize(edges: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Grid cells ``(i, j, polygon)`` by scan line: the later polygon wins a contested cell.

    Each edge yields the rows whose centre line it crosses; inside a row the crossings are paired
    in order and the cells between a pair are filled. ``cells`` keeps only those cells.
    """
    row = lambda lat: F.floor((lat - LAT_ORIGIN) / D_LAT).cast("int")
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    lines = edges.withColumn("i", F.explode(F.sequence(row(low) - 1, row(high) + 1)))
    lines = lines.withColumn("_lat", F.lit(LAT_ORIGIN) + (F.col("i") + 0.5) * D_LAT)
    lines = lines.where("(lat1 <= _lat AND _lat < lat2) OR (lat2 <= _lat AND _lat < lat1)")
    lines = lines.select(
        "polygon", "ord", "i",
        F.expr("lng1 + (_lat - lat1) / (lat2 - lat1) * (lng2 - lng1)").alias("x"),
    )
    order = Window.partitionBy("ord", "polygon", "i").orderBy("x")
    spans = (
        lines.withColumns({"_k": F.row_number().over(order), "_end": F.lead("x").over(order)})
        .where("_k % 2 = 1 AND _end IS NOT NULL")
        .select("polygon", "ord", "i", F.col("x").alias("_start"), "_end")
    )
    column = lambda lng: F.floor((F.col(lng) - LNG_ORIGIN) / D_LNG).cast("int")
    filled = spans.withColumn("j", F.explode(F.sequence(column("_start"), column("_end"))))
    owned = filled.groupBy("i", "j").agg(F.max(F.struct("ord", "polygon")).alias("_p"))
    owned = owned.select("i", "j", F.col("_p.polygon").alias("polygon"))
    return owned if cells is None else owned.join(cells.select("i", "j").distinct(), ["i", "j"], "left_semi")
