"""The 100 m grid: what lies in, reaches, or is nearest to each cell, and queries over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import (
    CELL_M, D_LAT, D_LNG, LAT_M_PER_DEG, LAT_ORIGIN, LNG_M_PER_DEG, LNG_ORIGIN,
    bbox_cells, centre_lat, centre_lng, coarse, half_even,
)
from ..session import cut
from . import scoring
from .graph import components

# Radii, search limit, least households, levels, viewport limits.
CORE_M, EXTENDED_M, NEAREST_M = 500, 1000, 3000
MIN_HOUSEHOLDS = 200
FACTORS = (1, 3, 9)
MAX_CELLS, MAX_POINTS, MAX_SITES = 20000, 2000, 60
# Mode: table, value, aggregate inside a cell, aggregate across child cells.
MODES = {
    "coverage": ("coverage", "count", "sum", "avg"),
    "point": ("cell", "count", "sum", "sum"),
    "nearest": ("nearest", "distance_m", "min", "min"),
}


@dataclass
class Grid:
    """The tables of a built grid; ``radius`` maps a layer to its metres of influence."""

    zone: DataFrame
    coverage: DataFrame | None = None
    cell: DataFrame | None = None
    nearest: DataFrame | None = None
    household: DataFrame | None = None
    members: DataFrame | None = None
    sites: DataFrame | None = None
    radius: Mapping[str, int] = field(default_factory=dict)


def with_cell(points: DataFrame) -> DataFrame:
    return points.selectExpr(
        "*",
        f"cast(floor((lat - {LAT_ORIGIN}D) / {D_LAT!r}D) AS int) AS i",
        f"cast(floor((lng - {LNG_ORIGIN}D) / {D_LNG!r}D) AS int) AS j",
    )


def disk_cells(points: DataFrame, radius: str) -> DataFrame:
    """Explodes every point to the cells whose centre is within ``radius`` (SQL: column or number).

    Adds ``i``, ``j`` and ``d2``, the squared planar metres to the centre. A point turns into
    hundreds of rows, so the points are spread over all cores first: sizes in bytes say little here.
    """
    points = points.repartition(points.sparkSession.sparkContext.defaultParallelism)
    span = f"cast(floor({radius} / {CELL_M}D) AS int) + 1"
    dy = f"({LAT_ORIGIN}D + (i + 0.5D) * {D_LAT!r}D - lat) * {LAT_M_PER_DEG}D"
    dx = f"({LNG_ORIGIN}D + (j + 0.5D) * {D_LNG!r}D - lng) * {LNG_M_PER_DEG}D"
    own = with_cell(points).withColumnsRenamed({"i": "_i", "j": "_j"})
    rows = own.selectExpr("*", f"explode(sequence(_i - ({span}), _i + {span})) AS i")
    rows = rows.where(f"abs({dy}) <= {radius}")
    cells = rows.selectExpr("*", f"explode(sequence(_j - ({span}), _j + {span})) AS j").drop("_i", "_j")
    return cells.selectExpr("*", f"({dx}) * ({dx}) + ({dy}) * ({dy}) AS d2").where(
        f"d2 <= {radius} * {radius}"
    )


def in_zone(cells: DataFrame, zone: DataFrame) -> DataFrame:
    return cells.join(zone.select("i", "j"), ["i", "j"], "left_semi")


def point_counts(pois: DataFrame, zone: DataFrame | None = None) -> DataFrame:
    """Weighted pois located in each cell, by layer and subtype."""
    counts = with_cell(pois).groupBy("i", "j", "layer", "subtype").agg(F.sum("weight").alias("count"))
    return counts if zone is None else in_zone(counts, zone)


def coverage(pois: DataFrame, zone: DataFrame) -> DataFrame:
    """Weighted pois whose influence (``radius_m``) reaches each cell, by layer and subtype.

    Pois at one coordinate are merged before the explosion; its rows are folded by partial
    aggregation in the same stage.
    """
    merged = pois.groupBy("lat", "lng", "layer", "subtype", "radius_m").agg(F.sum("weight").alias("w"))
    reached = disk_cells(merged, "radius_m")
    sums = reached.groupBy("i", "j", "layer", "subtype").agg(F.sum("w").alias("count"))
    return in_zone(sums, zone)


def household_coverage(sites: DataFrame, zone: DataFrame, radii: Sequence[int]) -> DataFrame:
    """Households within each radius of each cell; one explosion serves all radii."""
    homes = sites.where("households > 0").groupBy("lat", "lng").agg(F.sum("households").alias("h"))
    reached = disk_cells(homes, str(max(radii)))
    wanted = sorted(set(radii))
    sums = reached.groupBy("i", "j").agg(
        *[F.sum(F.when(F.col("d2") <= r * r, F.col("h"))).alias(f"h{r}") for r in wanted]
    )
    rows = F.array(*[F.struct(F.lit(r).alias("radius_m"), F.col(f"h{r}").alias("households")) for r in wanted])
    long = sums.select("i", "j", F.explode(rows).alias("e")).select("i", "j", "e.*")
    return in_zone(long.where("households IS NOT NULL"), zone)


def cell_sites(sites: DataFrame, extended_m: int = EXTENDED_M, core_m: int = CORE_M) -> DataFrame:
    """Which sites a cell belongs to, and whether as core."""
    reached = disk_cells(sites.select("site_id", "gu", "dong", "lat", "lng"), str(extended_m))
    return reached.select(
        "i", "j", "site_id", "gu", "dong", "d2", (F.col("d2") <= core_m * core_m).alias("in_core")
    )


def zone_cells(members: DataFrame, districts: DataFrame | None = None, border: DataFrame | None = None) -> DataFrame:
    """One row per cell: core flag, sites, district and neighbourhood, metres to the border.

    The district comes from the polygons; outside them, and for the neighbourhood, from the
    nearest site.
    """
    near = F.min(F.struct("d2", "site_id", "gu", "dong"))
    zone = members.groupBy("i", "j").agg(
        F.max("in_core").alias("in_core"), F.count("*").alias("site_count"), near.alias("_n")
    )
    if districts is not None:
        zone = zone.join(districts.select("i", "j", F.col("polygon").alias("_gu")), ["i", "j"], "left")
    else:
        zone = zone.withColumn("_gu", F.lit(None).cast("string"))
    zone = zone.select(
        "i", "j", "in_core", "site_count", F.coalesce("_gu", "_n.gu").alias("gu"), F.col("_n.dong").alias("dong")
    )
    if border is None:
        return zone.withColumn("border_m", F.lit(0))
    return zone.join(border, ["i", "j"], "left").fillna(0, ["border_m"])


def cell_nearest(
    zone: DataFrame, pois: DataFrame, layers: Sequence[str], max_m: int = NEAREST_M, first_m: int = 300
) -> DataFrame:
    """Whole planar metres from every cell centre to the nearest poi of each layer, up to ``max_m``.

    Cells look for pois in a small ring first; only (cell, layer) pairs without a hit go on to a
    wider one, so dense layers never meet the full radius.
    """
    points = pois.where(F.col("layer").isin(list(layers))).select("layer", "lat", "lng").distinct()
    centres = zone.select("i", "j", centre_lat("i").alias("clat"), centre_lng("j").alias("clng"))
    left = centres.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in layers])))
    found, radius = None, min(first_m, max_m)
    d2 = (
        f"power((clat - lat) * {LAT_M_PER_DEG}D, 2) + power((clng - lng) * {LNG_M_PER_DEG}D, 2)"
    )
    while True:
        bucket = lambda lat, lng: (
            f"floor(({lat} - {LAT_ORIGIN}D) * {LAT_M_PER_DEG}D / {radius})",
            f"floor(({lng} - {LNG_ORIGIN}D) * {LNG_M_PER_DEG}D / {radius})",
        )
        bi, bj = bucket("clat", "clng")
        asked = left.selectExpr("*", f"explode(sequence({bi} - 1, {bi} + 1)) AS _bi").selectExpr(
            "*", f"explode(sequence({bj} - 1, {bj} + 1)) AS _bj"
        )
        pi, pj = bucket("lat", "lng")
        offered = points.selectExpr("*", f"{pi} AS _bi", f"{pj} AS _bj")
        hits = (
            asked.join(offered, ["layer", "_bi", "_bj"])
            .selectExpr("i", "j", "layer", f"{d2} AS d2")
            .where(f"d2 <= {radius}D * {radius}D")
            .groupBy("i", "j", "layer")
            .agg(F.rint(F.sqrt(F.min("d2"))).cast("int").alias("distance_m"))
        )
        if radius >= max_m:
            return hits if found is None else found.unionByName(hits)
        hits = cut(hits)
        found = hits if found is None else found.unionByName(hits)
        left = cut(left.join(hits, ["i", "j", "layer"], "left_anti"))
        if left.isEmpty():
            return found
        radius = min(radius * 4, max_m)


# --- Queries ----------------------------------------------------------------------------------


def safe_zone(grid: Grid, layer: str) -> DataFrame:
    """Cells whose influence radius stays inside the border."""
    radius = grid.radius.get(layer)
    return grid.zone if radius is None else grid.zone.where(F.col("border_m") >= radius)


def cell_values(
    grid: Grid, layer: str, mode: str, factor: int = 1, subtypes: Sequence[str] | None = None,
    core_only: bool = False, exclude_edge: bool = False, per_households: bool = False,
    bounds: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """``(gi, gj, value)``: aggregated inside a cell, then across the cells of a coarser one.

    ``per_households`` turns sums into values per 1,000 households at the layer's radius, for cells
    with enough households. Layer, subtype and bounds are plain filters and reach the scan.
    """
    table, column, inner, outer = MODES[mode]
    rows = getattr(grid, table).where(F.col("layer") == layer)
    if bounds is not None:
        i0, i1, j0, j1 = bbox_cells(*bounds)
        rows = rows.where(F.col("i").between(i0, i1) & F.col("j").between(j0, j1))
    if subtypes and mode != "nearest":
        rows = rows.where(F.col("subtype").isin(list(subtypes)))
    if core_only:
        rows = in_zone(rows, grid.zone.where("in_core"))
    if exclude_edge:
        rows = in_zone(rows, safe_zone(grid, layer))
    values = rows.groupBy("i", "j").agg(getattr(F, inner)(column).alias("v"))
    if per_households and mode != "nearest":
        homes = grid.household.where(
            (F.col("radius_m") == grid.radius[layer]) & (F.col("households") >= MIN_HOUSEHOLDS)
        )
        values = values.join(homes.select("i", "j", "households"), ["i", "j"]).withColumn(
            "v", F.col("v") * 1000.0 / F.col("households")
        )
    if factor == 1:
        return values.select(F.col("i").alias("gi"), F.col("j").alias("gj"), F.col("v").cast("double").alias("value"))
    return values.groupBy(coarse("i", factor).alias("gi"), coarse("j", factor).alias("gj")).agg(
        getattr(F, outer)("v").cast("double").alias("value")
    )


def zone_count(grid: Grid, factor: int = 1, core_only: bool = False, min_border: int | None = None) -> DataFrame:
    """How many cells of a level the zone has (one row, ``cells``)."""
    zone = grid.zone
    if core_only:
        zone = zone.where("in_core")
    if min_border is not None:
        zone = zone.where(F.col("border_m") >= min_border)
    level = zone.select(coarse("i", factor).alias("gi"), coarse("j", factor).alias("gj")).distinct()
    return level.agg(F.count("*").alias("cells"))


def _population(grid: Grid, layer, mode, factor, subtypes, core_only, per_households):
    values = cell_values(
        grid, layer, mode, factor, subtypes, core_only, exclude_edge=True, per_households=per_households
    ).select("value")
    if mode == "nearest" or per_households:
        return values, None
    total = zone_count(grid, factor, core_only, grid.radius.get(layer)).withColumn("_one", F.lit(1))
    measured = values.agg(F.count("*").alias("measured")).withColumn("_one", F.lit(1))
    missing = total.join(measured, "_one").select(
        F.greatest(F.col("cells") - F.col("measured"), F.lit(0)).alias("missing")
    )
    return values, missing


def scale_table(
    grid: Grid, layer: str, mode: str, factor: int = 1, subtypes=None, core_only=False, per_households=False
) -> DataFrame:
    """The 101 quantile breaks of a selection over the whole zone, cells without a row counted as 0.

    No fill for nearest distances or per-household values; border cells are left out.
    """
    values, missing = _population(grid, layer, mode, factor, subtypes, core_only, per_households)
    return scoring.break_table(values, missing)


def scale(grid: Grid, layer: str, mode: str, factor: int = 1, subtypes=None, core_only=False, per_households=False) -> list[float]:
    """The breaks as 101 numbers."""
    values, missing = _population(grid, layer, mode, factor, subtypes, core_only, per_households)
    return scoring.breaks(values, missing)


def compare_layers(
    grid: Grid, layer_a: str, layer_b: str, factor: int = 1, subtypes_a=None, subtypes_b=None,
    core_only: bool = False, per_households: bool = False, bounds=None, exclude_edge: bool = False,
) -> DataFrame:
    """Percentile of A minus percentile of B per cell (``diff, pa, pb``); a missing side counts as 0."""
    cuts_a = scale(grid, layer_a, "coverage", factor, subtypes_a, core_only, per_households)
    cuts_b = scale(grid, layer_b, "coverage", factor, subtypes_b, core_only, per_households)
    pick = lambda layer, subtypes: cell_values(
        grid, layer, "coverage", factor, subtypes, core_only, exclude_edge, per_households, bounds
    )
    a = pick(layer_a, subtypes_a).withColumnRenamed("value", "_a")
    b = pick(layer_b, subtypes_b).withColumnRenamed("value", "_b")
    both = a.join(b, ["gi", "gj"], "full_outer").fillna(0.0, ["_a", "_b"])
    pa, pb = scoring.percentile_of("_a", cuts_a), scoring.percentile_of("_b", cuts_b)
    return both.select("gi", "gj", (pa - pb).alias("diff"), pa.alias("pa"), pb.alias("pb"))


def _bounds_of() -> list[Column]:
    return [
        (F.lit(LAT_ORIGIN) + F.min("i") * D_LAT).alias("min_lat"),
        (F.lit(LAT_ORIGIN) + (F.max("i") + 1) * D_LAT).alias("max_lat"),
        (F.lit(LNG_ORIGIN) + F.min("j") * D_LNG).alias("min_lng"),
        (F.lit(LNG_ORIGIN) + (F.max("j") + 1) * D_LNG).alias("max_lng"),
    ]


def _area() -> Column:
    return half_even(F.count("*") * (CELL_M / 1000) ** 2, 3).alias("area_km2")


def imbalance_clusters(
    grid: Grid, layer_a: str, layer_b: str, threshold: int = 40, min_cells: int = 10, limit: int = 40, **selection
) -> DataFrame:
    """Connected areas where A is high and B is low, the largest first, described.

    Cells near the border are left out on both sides before cells are joined.
    """
    reach = max(grid.radius.get(layer_a, 0), grid.radius.get(layer_b, 0))
    usable = grid.zone.where(F.col("border_m") >= reach).select(F.col("i").alias("gi"), F.col("j").alias("gj"))
    compared = compare_layers(grid, layer_a, layer_b, exclude_edge=True, **selection)
    flagged = cut(
        compared.join(usable, ["gi", "gj"], "left_semi")
        .where(F.col("diff") >= threshold)
        .select(F.col("gi").alias("i"), F.col("gj").alias("j"), "diff")
    )
    cells = components(flagged).join(flagged, ["i", "j"])
    clusters = cells.groupBy("cid").agg(
        F.count("*").alias("cells"), _area(), half_even(F.avg("diff"), 1).alias("mean_diff"),
        F.max("diff").alias("max_diff"), *_bounds_of(),
    ).where(F.col("cells") >= min_cells)
    top = clusters.orderBy(F.desc("cells"), "cid").limit(limit)
    inside = cells.join(top.select("cid"), "cid", "left_semi").join(
        grid.members.select("i", "j", "site_id", "gu", "dong"), ["i", "j"]
    ).select("cid", "site_id", "gu", "dong").distinct()
    totals = inside.groupBy("cid").agg(F.count("*").alias("site_count"))
    return top.join(totals, "cid", "left").join(top_places(inside), "cid", "left").fillna(0, ["site_count"])


def top_places(inside: DataFrame, weight: str | None = None, limit: int = 3) -> DataFrame:
    """The ``limit`` largest (gu, dong) of each cluster, by sites or by a weight, as text."""
    size = F.sum(weight) if weight else F.count("*")
    places = inside.groupBy("cid", "gu", "dong").agg(size.alias("n"))
    order = Window.partitionBy("cid").orderBy(F.desc("n"), "gu", "dong")
    top = places.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("_r", "gu", "dong", "n")))
    return top.groupBy("cid").agg(
        F.array_join(F.transform(listed, lambda p: F.concat_ws(":", p["gu"], p["dong"], p["n"].cast("string"))), "|").alias("places")
    )


def transit_gap_cells(
    grid: Grid, min_distance_m: int = 800, bus_percentile: int = 50, core_only: bool = False,
    exclude_corridor: bool = True, bus: str = "bus_stop", rail: str = "subway", corridor: str = "중앙차로",
    missing_m: int = NEAREST_M,
) -> DataFrame:
    """Cells with enough buses, no near railway and no bus corridor: ``i, j, distance_m``."""
    cuts = scale(grid, bus, "coverage", core_only=core_only)
    floor = cuts[bus_percentile] if cuts else 0
    served = cell_values(grid, bus, "coverage", core_only=core_only, exclude_edge=True).where(
        F.col("value") >= floor
    ).select(F.col("gi").alias("i"), F.col("gj").alias("j"))
    if exclude_corridor:
        lanes = grid.coverage.where((F.col("layer") == bus) & (F.col("subtype") == corridor))
        served = served.join(lanes.select("i", "j"), ["i", "j"], "left_anti")
    near = grid.nearest.where(F.col("layer") == rail).select("i", "j", "distance_m")
    far = served.join(near, ["i", "j"], "left").fillna(missing_m, ["distance_m"])
    return far.where(F.col("distance_m") > min_distance_m)


def upper_median(cells: DataFrame, value: str = "distance_m") -> DataFrame:
    """The element at position n/2 of each cluster's sorted values.

    Over a histogram of whole metres, so a huge cluster is not gathered anywhere.
    """
    hist = cells.groupBy("cid", value).agg(F.count("*").alias("n"))
    order = Window.partitionBy("cid").orderBy(value)
    run = hist.withColumns(
        {"_upto": F.sum("n").over(order), "_total": F.sum("n").over(Window.partitionBy("cid"))}
    )
    middle = F.floor(F.col("_total") / 2)
    hit = run.where((F.col("_upto") > middle) & (F.col("_upto") - F.col("n") <= middle))
    return hit.select("cid", F.col(value).alias("median_distance_m"))


def transit_gap(grid: Grid, min_cells: int = 20, limit: int = 30, **selection) -> DataFrame:
    """Connected areas without railway, by households living in them; totals over all clusters."""
    flagged = cut(transit_gap_cells(grid, **selection))
    cells = components(flagged).join(flagged, ["i", "j"])
    clusters = cells.groupBy("cid").agg(
        F.count("*").alias("cells"), _area(), F.max("distance_m").alias("max_distance_m"), *_bounds_of()
    ).where(F.col("cells") >= min_cells)
    kept = cells.join(clusters.select("cid"), "cid", "left_semi")
    homes = with_cell(grid.sites.select("site_id", "gu", "dong", "households", "lat", "lng"))
    inside = kept.select("cid", "i", "j").join(homes, ["i", "j"])
    loads = inside.groupBy("cid").agg(F.sum("households").alias("households"), F.count("*").alias("site_count"))
    described = (
        clusters.join(loads, "cid", "left")
        .join(upper_median(kept), "cid", "left")
        .join(top_places(inside, "households"), "cid", "left")
        .fillna(0, ["households", "site_count"])
        .withColumn("_one", F.lit(1))
    )
    totals = described.groupBy("_one").agg(
        F.sum("households").alias("total_households"), F.sum("site_count").alias("total_sites"),
        half_even(F.sum("area_km2"), 1).alias("total_area_km2"), F.count("*").alias("cluster_count"),
    )
    return (
        described.join(totals, "_one").drop("_one").orderBy(F.desc("households"), "cid").limit(limit)
    )


def viewport_cells(grid: Grid, layer: str, mode: str, bounds, factor: int = 1, limit: int = MAX_CELLS, **selection) -> DataFrame:
    """Cell values in a bounding box with an edge flag; one row more than ``limit`` shows truncation."""
    values = cell_values(grid, layer, mode, factor, bounds=bounds, **selection)
    radius = grid.radius.get(layer, 0)
    edge = grid.zone.where(F.col("border_m") < radius).select(
        coarse("i", factor).alias("gi"), coarse("j", factor).alias("gj"), F.lit(1).alias("edge")
    ).distinct()
    top = values.orderBy("gi", "gj").limit(limit + 1)
    return top.join(edge, ["gi", "gj"], "left").select(
        "gi", "gj", half_even("value", 2).alias("value"), F.coalesce("edge", F.lit(0)).alias("edge")
    )


def viewport_points(grid: Grid, layer: str, bounds, subtypes=None, limit: int = MAX_POINTS) -> DataFrame:
    """Located pois in a bounding box at their cell centres."""
    i0, i1, j0, j1 = bbox_cells(*bounds)
    rows = grid.cell.where(
        (F.col("layer") == layer) & F.col("i").between(i0, i1) & F.col("j").between(j0, j1)
    )
    if subtypes:
        rows = rows.where(F.col("subtype").isin(list(subtypes)))
    return rows.orderBy("i", "j", "subtype").limit(limit + 1).select(
        centre_lat("i").alias("lat"), centre_lng("j").alias("lng"), "subtype", "count"
    )


def cell_detail(grid: Grid, i: int, j: int) -> dict[str, DataFrame]:
    """Everything about one cell: zone row, coverage, nearest, up to 60 sites."""
    here = (F.col("i") == i) & (F.col("j") == j)
    sites = grid.members.where(here).select("site_id", "in_core").join(
        grid.sites.select("site_id", "name", "gu", "dong", "lat", "lng"), "site_id"
    )
    return {
        "zone": grid.zone.where(here),
        "coverage": grid.coverage.where(here).orderBy("layer", "subtype"),
        "nearest": grid.nearest.where(here),
        "sites": sites.orderBy(F.desc("in_core"), "name", "site_id").limit(MAX_SITES),
    }


def layer_meta(grid: Grid, registry: DataFrame, pois: DataFrame) -> DataFrame:
    """Registry rows with poi counts, the subtypes that cover any cell, and whether distances exist."""
    counts = pois.groupBy("layer").agg(F.count("*").alias("poi_count"))
    kinds = grid.coverage.select("layer", "subtype").distinct().groupBy("layer").agg(
        F.array_join(F.array_sort(F.collect_list("subtype")), ",").alias("subtypes")
    )
    near = grid.nearest.select("layer").distinct().withColumn("has_nearest", F.lit(True))
    return (
        registry.join(counts, "layer", "left").join(kinds, "layer", "left").join(near, "layer", "left")
        .fillna(0, ["poi_count"]).fillna(False, ["has_nearest"])
    )


def label_positions(grid: Grid) -> DataFrame:
    """Where to print a district's name: the mean of its cells."""
    return grid.zone.where(F.col("gu").isNotNull()).groupBy("gu").agg(
        (F.lit(LAT_ORIGIN) + (F.avg("i") + 0.5) * D_LAT).alias("lat"),
        (F.lit(LNG_ORIGIN) + (F.avg("j") + 0.5) * D_LNG).alias("lng"),
        F.count("*").alias("cells"),
    )


def layer_correlation(grid: Grid, layers: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of layers over all cells of the zone (no row means 0).

    Average ranks come from a histogram per layer; all pairs are then correlated in one pass over
    one wide row per cell.
    """
    sums = grid.coverage.where(F.col("layer").isin(list(layers))).groupBy("i", "j", "layer").agg(F.sum("count").alias("v"))
    filled = grid.zone.select("i", "j").withColumn("layer", F.explode(F.array(*[F.lit(x) for x in layers])))
    values = filled.join(sums, ["i", "j", "layer"], "left").fillna(0.0, ["v"])
    hist = values.groupBy("layer", "v").agg(F.count("*").alias("n"))
    ranked = scoring.running_count(hist, "v", "n", ("layer",)).select(
        "layer", "v", (F.col("below") + (F.col("n") + 1) / 2).alias("r")
    )
    wide = (
        values.join(ranked, ["layer", "v"])
        .groupBy("i", "j")
        .agg(*[F.max(F.when(F.col("layer") == x, F.col("r"))).alias(f"r{k}") for k, x in enumerate(layers)])
    )
    pairs = [(a, b) for a in range(len(layers)) for b in range(a + 1, len(layers))]
    one = wide.agg(*[F.corr(f"r{a}", f"r{b}").alias(f"c{a}_{b}") for a, b in pairs])
    rows = F.array(
        *[
            F.struct(F.lit(layers[a]).alias("layer_a"), F.lit(layers[b]).alias("layer_b"), F.col(f"c{a}_{b}").alias("rho"))
            for a, b in pairs
        ]
    )
    return one.select(F.explode(rows).alias("p")).select("p.*").withColumn("rho", half_even("rho", 3))
