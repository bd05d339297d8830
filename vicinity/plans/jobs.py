"""Batch jobs: the grid build, baselines with baked scores, and a runner that isolates failures."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import CITY_BOUNDS, POI_MARGIN_DEG, bbox_cells
from ..operators import baseline, graph, grid, polygons, radius
from ..operators.grid import Grid
from ..operators.scoring import mid_rank
from ..session import cut
from ..sources.sinks import write_baseline
from . import category_tables
from .registries import CATEGORIES, Category

NEAREST_LAYERS = ("subway", "school", "hospital", "pharmacy", "child_zone")


def region_box() -> tuple[int, int, int, int]:
    """Cells of the city box with its margin."""
    low_lat, high_lat, low_lng, high_lng = CITY_BOUNDS
    m = POI_MARGIN_DEG
    return bbox_cells(low_lat - m, low_lng - m, high_lat + m, high_lng + m)


def build_grid(
    sites: DataFrame, pois: DataFrame, reach: Mapping[str, int], district_edges: DataFrame, path: str,
    nearest_layers: Sequence[str] = NEAREST_LAYERS, box: tuple[int, int, int, int] | None = None,
) -> Grid:
    """Builds every grid table and writes it, then opens what was written.

    Layer tables are partitioned by layer and clustered by cell inside a layer, so a layer or a
    viewport reads only its files and row groups. ``pois`` has ``layer, subtype, weight, radius_m``.
    """
    spark = sites.sparkSession
    write(grid.cell_sites(sites), f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    districts = polygons.rasterize(district_edges)
    border = graph.border_distance(districts, box or region_box())
    write(grid.zone_cells(members, districts, border), f"{path}/zone")
    zone = spark.read.parquet(f"{path}/zone")
    write(grid.point_counts(pois, zone), f"{path}/cell", by="layer")
    write(grid.coverage(pois, zone), f"{path}/coverage", by="layer")
    near = grid.cell_nearest(zone, pois, [x for x in nearest_layers if x in reach])
    write(near, f"{path}/nearest", by="layer")
    write(grid.household_coverage(sites, zone, sorted(set(reach.values()))), f"{path}/household")
    write(sites, f"{path}/sites", cells=False)
    return open_grid(spark, path, reach)


def write(df: DataFrame, path: str, by: str | None = None, cells: bool = True) -> None:
    """Parquet, partitioned by ``by``; rows of a grid tile lie together, sorted by cell.

    File statistics can then skip tiles. The rebalance hint splits a tile that is too large for one
    file and merges small ones; nothing is sampled first.
    """
    if cells:
        keys = [*([by] if by else []), "_ti", "_tj"]
        tiled = df.withColumns({"_ti": F.floor(F.col("i") / 64), "_tj": F.floor(F.col("j") / 64)})
        df = tiled.hint("rebalance", *keys).sortWithinPartitions(*([by] if by else []), "i", "j").drop("_ti", "_tj")
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def open_grid(spark: SparkSession, path: str, reach: Mapping[str, int]) -> Grid:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Grid(
        zone=read("zone"), coverage=read("coverage"), cell=read("cell"), nearest=read("nearest"),
        household=read("household"), members=read("members"), sites=read("sites"), radius=dict(reach),
    )


def bake_scores(table: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Adds ``{metric}_pct`` and ``{metric}_score`` for every metric (``higher`` or ``lower`` is better)."""
    for metric, better in metrics.items():
        scored = mid_rank(table, metric, better)
        table = scored.withColumnsRenamed({"pct": f"{metric}_pct", "score": f"{metric}_score"})
    return table


def category_baseline(sites: DataFrame, pois: DataFrame | Mapping[str, DataFrame], category: Category) -> DataFrame:
    """One category's table: counts per radius, subtype columns, nearest, items, its own columns, baked score.

    ``pois``: ``poi_id, name, subtype, lat, lng``, or a mapping with these as ``places`` and what else the category needs
    (see ``category_tables``). Counts share a join, subtypes, nearest and the item list have one each.
    """
    sources = pois if isinstance(pois, Mapping) else {"places": pois}
    if category.key in category_tables.INSTEAD:
        own = category_tables.INSTEAD[category.key](sites, sources)
        return bake_scores(cut(sites.join(own, "site_id", "left")), {category.metric: category.better})
    pois = sources["places"]
    key = category.key
    out = sites
    if category.radii:
        counts = baseline.radius_counts(
            sites.select("site_id", "lat", "lng"), pois, category.radii, rounding=category.rounding
        ).drop("lat", "lng")
        renamed = {f"count_{r}m": f"{key}_count_{r}m" for r in category.radii}
        out = out.join(counts.withColumnsRenamed(renamed), "site_id")
    if category.unbounded:
        near = radius.nearest(sites, pois).select("site_id", F.col("distance_m").alias("nearest_distance"))
        out = (out.drop("nearest_distance")).join(near, "site_id", "left")
    if category.subtypes:
        kinds = baseline.subtype_counts(
            sites.select("site_id", "lat", "lng"), pois, category.subtypes, category.subtype_radius, rounding=category.rounding
        ).drop("lat", "lng", "total")
        out = out.join(kinds, "site_id")
        if category.metric == "cafe_access_raw":
            names = [f"{stem}_count" for stem in category.subtypes.values()]
            out = out.withColumn("cafe_access_raw", baseline.cafe_access(names))
    if category.items:
        listed = baseline.items(
            sites.select("site_id", "lat", "lng"), pois, category.item_radius, category.items, rounding=category.rounding
        )
        out = out.join(listed.select("site_id", F.to_json("items").alias("items_json")), "site_id")
    if category.key in category_tables.BESIDE:
        out = out.join(category_tables.BESIDE[category.key](sites, sources), "site_id", "left")
    return bake_scores(cut(out), {category.metric: category.better})


def baseline_jobs(sites: DataFrame, pois: Mapping[str, DataFrame | Mapping[str, DataFrame]], folder: str) -> dict[str, Callable[[], DataFrame]]:
    """A job per category with a source: builds its table, writes it and opens what was written."""

    def job(category: Category) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            write_baseline(category_baseline(sites, pois[category.key], category), folder, category.key)
            return sites.sparkSession.read.parquet(f"{folder}/{category.key}")

        return run

    return {key: job(c) for key, c in CATEGORIES.items() if key in pois}


def run_jobs(spark: SparkSession, jobs: Mapping[str, Callable[[], DataFrame | None]]) -> DataFrame:
    """Runs jobs one by one; a failing one is reported and skipped. Returns the report rows."""
    report = []
    for name, job in jobs.items():
        started = time.time()
        try:
            made = job()
            rows = made.count() if made is not None else None
            columns = ",".join(made.columns) if made is not None else None
            report.append((name, "success", rows, columns, None, round(time.time() - started, 3)))
        except Exception as error:
            last = traceback.format_exception_only(error)[-1].strip()
            report.append((name, "failed", None, None, last, round(time.time() - started, 3)))
    return spark.createDataFrame(report, "job string, status string, rows long, columns string, error string, seconds double")


