"""Nearest places by a pyramid of counted cells.

Places are points of the unit sphere in space, where straight distance orders pairs like great-circle distance and no
pole or date line needs care. A pyramid counts them in cubes of side 2, 1/2, 1/8, ... and keeps the box around those of
each cube. A site starts at the smallest of its own cubes that holds enough places, so dense and empty country each get
a circle of their own. From there cubes are taken apart by the pyramid while more than a few places are in them: what is
farther away than a bound that enough places keep is left out at every step. Only the places of the last cubes are
measured, a few for each site however uneven the map is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m, whole_metres
from ..session import cut

#: Finest level (cubes of 3 m), levels of one step, coordinates of a cube that is not taken apart any more.
FINEST, STEP, FEW = 22, 2, 6
#: Whole metres tie within one metre, so bounds are wider by that.
_SLACK = 1.5 / EARTH_RADIUS_M
_AXES = ("x", "y", "z")
_BOX = [f"{side}_{a}" for a in _AXES for side in ("low", "high")]


def _in_space(df: DataFrame) -> DataFrame:
    """Coordinates on the unit sphere, and the number of the finest cube on each axis."""
    df = df.selectExpr(
        "*", "cos(radians(lat)) * cos(radians(lng)) AS x", "cos(radians(lat)) * sin(radians(lng)) AS y", "sin(radians(lat)) AS z"
    )
    return df.selectExpr("*", *(f"cast(least(floor(({a} + 1) * {2 ** (FINEST - 1)}D), {2**FINEST - 1}) AS int) AS c{a}" for a in _AXES))


def _every_level(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each level, with the number of the cube there."""
    rows = df.selectExpr(*columns, *(f"c{a} AS f{a}" for a in _AXES), f"explode(sequence(0, {FINEST}, {STEP})) AS level")
    return rows.selectExpr(*columns, "level", *(f"shiftright(f{a}, {FINEST} - level) AS c{a}" for a in _AXES))


def _with_reach(df: DataFrame) -> DataFrame:
    """Straight distances from a site to the nearest and to the farthest point of a cube's box."""
    near = " + ".join(f"pow(greatest(low_{a} - {a}, {a} - high_{a}, 0D), 2)" for a in _AXES)
    far = " + ".join(f"pow(greatest(abs({a} - low_{a}), abs({a} - high_{a})), 2)" for a in _AXES)
    return df.selectExpr("*", f"sqrt({near}) AS near", f"sqrt({far}) AS far").drop(*_BOX)


def _merged(places: DataFrame, k: int, id_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row for each coordinate: its ``k`` smallest ids, and how many of them."""
    if k == 1:
        one = places.groupBy("lat", "lng").agg(F.array(F.min(F.struct(id_col, *keep))).alias("few"))
        return _in_space(one.withColumn("many", F.lit(1)))
    at = Window.partitionBy("lat", "lng").orderBy(id_col)
    first = places.select(id_col, "lat", "lng", *keep).withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") <= k)
    few = F.array_sort(F.collect_list(F.struct(id_col, *keep)))
    return _in_space(first.groupBy("lat", "lng").agg(few.alias("few"), F.count("*").alias("many")))


def nearest_places(
    sites: DataFrame, places: DataFrame, k: int = 1, *, id_col: str = "poi_id", keep: tuple[str, ...] = (),
    others: bool = False,
) -> DataFrame:
    """``(site_id, <id_col>, <keep>, distance_m, rank, tested)``: the ``k`` nearest places of every site, however far.

    Distances are whole metres, ties go to the smallest id; fewer rows if there are fewer places. Rows without
    coordinates are left out on both sides. ``others``: a place whose id is the site's is not one of its places.
    ``tested`` counts the places that were measured for a site.
    """
    usable = "lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)"
    wanted = k + 1 if others else k
    points = cut(_merged(places.where(usable), wanted, id_col, keep))
    box = [f(a).alias(f"{side}_{a}") for a in _AXES for side, f in (("low", F.min), ("high", F.max))]
    filed = _every_level(points, "many", *_AXES).groupBy("level", "cx", "cy", "cz")
    cubes = cut(filed.agg(F.sum("many").alias("many"), F.count("*").alias("spots"), *box))
    sites = _in_space(sites.select("site_id", "lat", "lng").where(usable))
    many = (F.col("spots") > FEW) & (F.col("level") < FINEST)
    frontier = cut(_taken_apart(_start(sites, cubes, wanted), cubes, many, wanted))
    while not frontier.where(many).isEmpty():
        frontier = cut(_taken_apart(frontier, cubes, many, wanted))
    done = frontier.select("site_id", "lat", "lng", "level", "cx", "cy", "cz")
    found = done.join(_every_level(points.withColumnsRenamed({"lat": "_lat", "lng": "_lng"}), "_lat", "_lng", "few"), ["level", "cx", "cy", "cz"])
    found = found.select("site_id", whole_metres(haversine_m("lat", "lng", "_lat", "_lng")).alias("distance_m"), F.explode("few").alias("_place"))
    found = found.select("site_id", "distance_m", "_place.*")
    if others:
        found = found.where(F.col("site_id") != F.col(id_col))
    best = Window.partitionBy("site_id").orderBy("distance_m", id_col)
    ranked = found.withColumn("rank", F.row_number().over(best)).withColumn("tested", F.count("*").over(Window.partitionBy("site_id")))
    return ranked.where(F.col("rank") <= k).select("site_id", id_col, *keep, "distance_m", "rank", "tested")


def _start(sites: DataFrame, cubes: DataFrame, wanted: int) -> DataFrame:
    """The cubes, of at most eight, that hold all a site needs.

    The smallest own cube with enough places bounds the distance by its far corner, less than two sides away; cubes four
    times as wide reach that far in each direction with the nearer neighbour alone. The finest cubes don't count as own
    ones here: a bound is wider by a metre than they leave room for.
    """
    site = ["site_id", "lat", "lng", *_AXES]
    own = _every_level(sites, *site)
    enough = cubes.where(F.col("many") >= wanted).select("level", "cx", "cy", "cz", F.lit(True).alias("_real"), *_BOX)
    known = _with_reach(own.join(enough, ["level", "cx", "cy", "cz"], "left")).groupBy(*site)
    begun = known.agg(F.max(F.when(F.col("_real"), F.col("level"))).alias("level"), F.min("far").alias("bound"))
    begun = begun.withColumn("bound", F.coalesce("bound", F.lit(2.0)) + _SLACK)
    begun = begun.withColumn("level", F.greatest(F.least(F.coalesce("level", F.lit(0)), F.lit(FINEST - STEP)) - STEP, F.lit(0)))
    for a in _AXES:
        place = f"(({a} + 1) * shiftleft(1, level) / 2D)"
        begun = begun.selectExpr("*", f"explode(array(cast(floor({place}) AS int), cast(floor({place}) + if({place} - floor({place}) < 0.5D, -1, 1) AS int))) AS c{a}")
    return _with_reach(begun.join(cubes, ["level", "cx", "cy", "cz"])).where("near <= bound")


def _taken_apart(frontier: DataFrame, cubes: DataFrame, many: Column, wanted: int) -> DataFrame:
    """The cubes with few places, and in place of the others what is in them, as far as it can matter."""
    cube = ["level", "cx", "cy", "cz", "many", "spots"]
    inside = cubes.selectExpr(*(f"{c} AS _{c}" for c in cube), *_BOX, f"level - {STEP} AS _l", *(f"shiftright(c{a}, {STEP}) AS _p{a}" for a in _AXES))
    held = [F.when(many, F.col("level")) == inside["_l"], *(F.col(f"c{a}") == inside[f"_p{a}"] for a in _AXES)]
    met = _with_reach(frontier.withColumnsRenamed({"near": "_near", "far": "_far"}).join(inside, held, "left"))
    chosen = {c: F.coalesce(f"_{c}", c) for c in cube} | {"near": F.coalesce("near", "_near"), "far": F.coalesce("far", "_far")}
    parts = met.select(*(chosen[c].alias(c) if c in chosen else F.col(c) for c in frontier.columns))
    return _within(parts.where("near <= bound"), wanted)


def _within(frontier: DataFrame, wanted: int) -> DataFrame:
    """The cubes that can hold one of the ``wanted`` nearest: not beyond what that many places surely keep."""
    if wanted == 1:
        bounded = frontier.withColumn("bound", F.least("bound", F.min(F.col("far") + _SLACK).over(Window.partitionBy("site_id"))))
        return bounded.where("near <= bound")
    by_far = Window.partitionBy("site_id").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.min(F.when(F.col("_sum") >= wanted, F.col("far") + _SLACK)).over(Window.partitionBy("site_id"))
    bounded = frontier.withColumn("_sum", F.sum("many").over(by_far)).withColumn("bound", F.least("bound", sure))
    return bounded.where("near <= bound").drop("_sum")
