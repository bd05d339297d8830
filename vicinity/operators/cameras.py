"""Camera weights: agencies register rows per camera or per pole; both become camera counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_even
from .baseline import back_to_sites, site_points
from .radius import radius_join

# Fixed value: below this many rows per pole an agency registers poles, not cameras.
POLE_ROWS_MAX = 1.2


def camera_places(points: DataFrame, pole_rows_max: float = POLE_ROWS_MAX) -> DataFrame:
    """One row per coordinate: ``n`` registered rows, ``cameras`` = the real number of cameras.

    An agency that registers poles but never filled in the number of cameras gets the median
    cameras per pole of the other agencies. The weight of one row is ``cameras / n``.
    """
    poles = points.groupBy("agency", "lat", "lng").agg(
        F.count("*").alias("rows"), F.max("cameras").alias("cameras")
    )
    agencies = poles.groupBy("agency").agg(
        (F.sum("rows") / F.count("*")).alias("rows_per_pole"),
        F.max("cameras").alias("most"),
        (F.sum(F.greatest("rows", "cameras")) / F.count("*")).alias("per_pole"),
    )
    agencies = agencies.withColumn(
        "unfilled", (F.col("most") <= 1) & (F.col("rows_per_pole") < pole_rows_max)
    )
    usual = agencies.where(~F.col("unfilled")).agg(
        F.coalesce(F.percentile("per_pole", F.lit(0.5)), F.lit(1.0)).alias("usual")
    )
    imputed = (
        agencies.where("unfilled")
        .withColumn("_one", F.lit(1))
        .join(usual.withColumn("_one", F.lit(1)), "_one")
        .select("agency", "usual")
    )
    known = poles.join(imputed, "agency", "left").withColumn(
        "cameras", F.coalesce("usual", F.col("cameras").cast("double"))
    )
    return known.groupBy("lat", "lng").agg(
        F.sum("rows").alias("n"),
        F.greatest(F.sum("rows").cast("double"), F.max("cameras")).alias("cameras"),
    )


def weighted_camera_counts(
    sites: DataFrame, points: DataFrame, radii: tuple[int, ...] = (300, 500), kinds: dict | None = None
) -> DataFrame:
    """Cameras (half-even) and registered points per radius; ``kinds`` maps purpose -> column stem."""
    places = camera_places(points)
    columns = []
    if kinds:
        by_kind = points.groupBy("lat", "lng").agg(
            *[F.count_if(F.col("purpose") == k).alias(stem) for k, stem in kinds.items()]
        )
        places = places.join(by_kind, ["lat", "lng"])
        near = F.col("distance_m") <= max(radii)
        each = F.col("cameras") / F.col("n")
        columns = [
            half_even(F.sum(F.when(near, F.col(stem) * each))).cast("long").alias(f"{stem}_count")
            for stem in kinds.values()
        ]
    pairs = radius_join(site_points(sites), places, max(radii))
    for r in radii:
        near = F.col("distance_m") <= r
        columns.append(half_even(F.sum(F.when(near, F.col("cameras")))).cast("long").alias(f"camera_count_{r}m"))
        columns.append(F.sum(F.when(near, F.col("n"))).alias(f"point_count_{r}m"))
    counts = pairs.groupBy("lat", "lng").agg(*columns)
    return back_to_sites(sites, counts, [c for c in counts.columns if c not in ("lat", "lng")])
