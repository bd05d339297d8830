"""GeoJSON polygons as rings and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.polygons import edges_of


def read_polygons(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """``(polygon, ord, rings)`` from feature collections; the parts of a MultiPolygon join one list.

    Coordinates nest to different depths by type, so they are kept as text and parsed per type.
    """
    schema = (
        f"features array<struct<properties: struct<`{name}`: string>, "
        "geometry: struct<type: string, coordinates: string>>>"
    )
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    features = files.select(F.posexplode("features").alias("ord", "f"))
    rings = "array<array<array<double>>>"
    single = F.from_json("f.geometry.coordinates", rings)
    several = F.flatten(F.from_json("f.geometry.coordinates", f"array<{rings}>"))
    paths = F.when(F.col("f.geometry.type") == "Polygon", single).otherwise(several)
    points = F.transform(
        paths,
        lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat"))),
    )
    return features.select(F.col(f"f.properties.`{name}`").alias("polygon"), "ord", points.alias("rings"))


def read_edges(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    return edges_of(read_polygons(spark, path, name))


def boundary_rings(polygons: DataFrame) -> DataFrame:
    """Rings for drawing: ``(polygon, ring, path)`` with points as ``[lat, lng]``."""
    rows = polygons.select("polygon", F.posexplode("rings").alias("ring", "points"))
    return rows.select("polygon", "ring", F.transform("points", lambda p: F.array(p["lat"], p["lng"])).alias("path"))
