"""Per-site baselines: counts, nearest, subtype columns and item lists from one distance join.

Copies are merged before the join: pois at one coordinate become one row with a count, sites at
one coordinate one probe. What crosses the network is then bounded by distinct places. Counts
and nearest places come from ``circles``, which makes no pairs of what is well inside a circle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_even
from ..session import cut, spread
from . import circles
from .radius import radius_join


def site_points(sites: DataFrame) -> DataFrame:
    return sites.select("lat", "lng").distinct()


def back_to_sites(sites: DataFrame, per_point: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """Gives every site its point's row; sites without pairs get 0 in ``zero`` columns."""
    out = sites.join(per_point, ["lat", "lng"], "left")
    return out.fillna(0, subset=list(zero)) if zero else out


def radius_counts(
    sites: DataFrame,
    pois: DataFrame,
    radii: Sequence[int],
    *,
    rounding: str = "before",
    weight: str | None = None,
) -> DataFrame:
    """``count_{r}m`` for every radius and ``nearest_distance`` from one join at the largest.

    With ``weight`` also ``weight_{r}m``: half-even whole sums of the weight column, over the pairs.
    """
    heavy = [F.sum(weight).alias("w")] if weight else []
    places = pois.groupBy("lat", "lng").agg(F.count("*").alias("n"), *heavy)
    if not weight:
        found = circles.counts(site_points(sites), places, radii, rounding=rounding)
        renamed = {f"count_{k}": f"count_{r}m" for k, r in enumerate(radii)} | {"nearest_0": "nearest_distance"}
        return back_to_sites(sites, found.withColumnsRenamed(renamed), [f"count_{r}m" for r in radii])
    pairs = radius_join(site_points(sites), places, max(radii), rounding=rounding)
    compared = F.col("raw_m" if rounding == "after" else "distance_m")
    columns: list[Column] = []
    for r in radii:
        near = compared <= r
        columns.append(F.sum(F.when(near, F.col("n"))).alias(f"count_{r}m"))
        if weight:
            columns.append(half_even(F.sum(F.when(near, F.col("w")))).cast("long").alias(f"weight_{r}m"))
    zero = [f"count_{r}m" for r in radii] + ([f"weight_{r}m" for r in radii] if weight else [])
    counts = pairs.groupBy("lat", "lng").agg(*columns, F.min("distance_m").alias("nearest_distance"))
    return back_to_sites(sites, counts, zero)


def subtype_counts(
    sites: DataFrame,
    pois: DataFrame,
    subtypes: Mapping[str, str],
    radius_m: float,
    *,
    subtype: str = "subtype",
    rounding: str = "before",
    nearest: bool = True,
) -> DataFrame:
    """One count and one nearest column per subtype (value -> column stem), and ``diversity``.

    ``{stem}_count`` and, if wanted, ``nearest_{stem}``; ``total`` counts every poi, listed subtype or not.
    """
    places = pois.groupBy("lat", "lng", F.col(subtype).alias("kind")).agg(F.count("*").alias("n"))
    found = circles.counts(site_points(sites), places, [radius_m], kinds=list(subtypes), rounding=rounding, nearest=nearest)
    names = [f"{stem}_count" for stem in subtypes.values()]
    counted = [F.col(f"count_{k}").alias(name) for k, name in enumerate(names)]
    near = [F.col(f"nearest_{k}").alias(f"nearest_{stem}") for k, stem in enumerate(subtypes.values())] if nearest else []
    total = sum((F.col(f"count_{k}") for k in range(len(names))), F.col(f"count_{len(names)}"))
    wide = found.select("lat", "lng", *counted, *near, total.alias("total"))
    out = back_to_sites(sites, wide, [*names, "total"])
    return out.withColumn("diversity", diversity(names))


def diversity(counts: Sequence[str]) -> Column:
    """How many of the count columns are not zero."""
    total = F.lit(0)
    for name in counts:
        total = total + (F.col(name) > 0).cast("int")
    return total


def cafe_access(counts: Sequence[str]) -> Column:
    """Franchise total plus twice the number of brands present."""
    total = F.lit(0)
    for name in counts:
        total = total + F.col(name)
    return total + diversity(counts) * 2


def cafe_access_from_items(items: Column | str, brands: Sequence[str], radius_m: int = 500) -> Column:
    """The same raw score re-derived from an item array (``subtype``, ``distance``)."""
    items = F.col(items) if isinstance(items, str) else items
    hits = F.filter(
        items, lambda x: (x["distance"] <= radius_m) & x["subtype"].isin(list(brands))
    )
    kinds = F.array_distinct(F.transform(hits, lambda x: x["subtype"]))
    return F.size(hits) + F.size(kinds) * 2


def items(
    sites: DataFrame,
    pois: DataFrame,
    radius_m: float,
    cap: int,
    fields: Sequence[str] = ("name", "subtype"),
    *,
    rounding: str = "before",
) -> DataFrame:
    """``items``: the nearest ``cap`` pois per site as an ordered array of structs.

    A task keeps ``cap`` rows per point, so none ever gathers more of one site.
    """
    top = circles.nearest(site_points(sites), pois, radius_m, cap, keep=fields, rounding=rounding).withColumnRenamed("rank", "_rank")
    entry = F.struct(
        "_rank", F.col("distance_m").alias("distance"), "poi_id", *fields
    )
    listed = top.groupBy("lat", "lng").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    listed = listed.withColumn("items", F.transform("items", lambda x: x.dropFields("_rank")))
    out = sites.join(listed, ["lat", "lng"], "left")
    empty = F.array().cast(listed.schema["items"].dataType)
    return out.withColumn("items", F.coalesce("items", empty))


def display_items(sites: DataFrame, parts: Sequence[tuple[DataFrame, float]], cap: int, fields: Sequence[str] = ("name", "subtype"), *, rounding: str = "after") -> DataFrame:
    """One list from several sources, each within its own radius, nearest first (ties: source, id)."""
    points = site_points(sites)
    union = None
    for k, (pois, radius_m) in enumerate(parts):
        near = circles.nearest(points, pois, radius_m, cap, keep=fields, rounding=rounding)
        near = near.select("lat", "lng", "distance_m", F.lit(k).alias("part"), "poi_id", *fields)
        union = near if union is None else union.unionByName(near)
    order = Window.partitionBy("lat", "lng").orderBy("distance_m", "part", "poi_id")
    top = union.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap)
    entry = F.struct("_rank", F.col("distance_m").alias("distance"), "part", "poi_id", *fields)
    listed = top.groupBy("lat", "lng").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return sites.join(listed.withColumn("items", F.transform("items", lambda x: x.dropFields("_rank"))), ["lat", "lng"], "left")


def line_counts(sites: DataFrame, stations: DataFrame, radii: Sequence[int] = (500, 1000)) -> DataFrame:
    """Distinct lines and transfer stations around each site; ``stations`` has ``lines`` arrays."""
    points = site_points(sites)
    stations = stations.select("lat", "lng", "lines")
    out = sites
    for stem, some in (("transfer", stations.where(F.size("lines") >= 2)), ("station", stations)):
        places = some.groupBy("lat", "lng").agg(F.count("*").alias("n"))
        found = circles.counts(points, places, radii, nearest=False)
        named = {f"count_{k}": f"{stem}_count_{r}m" for k, r in enumerate(radii)}
        out = back_to_sites(out, found.withColumnsRenamed(named), list(named.values()))
    # A line is within a radius if its nearest station is.
    served = stations.select("lat", "lng", F.explode("lines").alias("line")).where("line IS NOT NULL")
    lines = circles.counts_by(points, served.groupBy("lat", "lng", "line").agg(F.count("*").alias("n")), max(radii), "line")
    named = [f"line_count_{r}m" for r in radii]
    by_line = lines.groupBy("lat", "lng").agg(*[F.count_if(F.col("nearest") <= r).alias(name) for r, name in zip(radii, named)])
    return back_to_sites(out, by_line, named)


def stop_routes(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """The sorted set of route names of each stop (``node_id``)."""
    sets = routes.groupBy("node_id").agg(F.array_sort(F.collect_set("route_name")).alias("routes"))
    return stops.join(sets, "node_id", "left")


def route_access(
    sites: DataFrame,
    stops: DataFrame,
    routes: DataFrame,
    route_type: Column,
    types: Sequence[str],
    *,
    radius_m: int = 500,
    preview: int = 20,
) -> DataFrame:
    """Distinct routes reachable within the radius, by type, with a sorted preview.

    ``route_type`` is a column over ``route_name``.
    """
    served = routes.select("node_id", "route_name").distinct()
    # A route's number goes by its name; with the type it makes one number.
    kind = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in types]), route_type).cast("int"), F.lit(0))
    numbered = served.select("route_name").distinct().withColumn("_kind", kind).withColumn("_one", F.lit(1))
    numbered = numbered.withColumn("_id", F.row_number().over(Window.partitionBy("_one").orderBy("route_name")).cast("long") * (len(types) + 1) + F.col("_kind"))
    numbered = cut(numbered.select("route_name", "_id"))
    by_stop = served.alias("s").join(numbered.alias("r"), F.col("s.route_name").eqNullSafe(F.col("r.route_name"))).select("node_id", "_id")
    places = stops.select("node_id", "lat", "lng").join(by_stop, "node_id").groupBy("lat", "lng").agg(F.collect_set("_id").alias("members"))
    found = cut(circles.members(site_points(sites), places, radius_m, len(types) + 1, preview, rounding="after"))
    shown = found.select("lat", "lng", F.explode("firsts").alias("_id")).join(numbered, "_id").groupBy("lat", "lng").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "route_name"))), lambda x: x["route_name"]), ", ").alias("available_routes")
    )
    named = [F.col(f"kind_{k + 1}").alias(f"{t}_count") for k, t in enumerate(types)]
    per_point = spread(found.select("lat", "lng", F.col("count").alias("route_count"), *named)).join(shown, ["lat", "lng"])
    zero = ["route_count", *[f"{t}_count" for t in types]]
    return back_to_sites(sites, per_point, zero)
