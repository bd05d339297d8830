"""Points in polygons by tiles, against counting the crossings of every edge."""

import math
import random

from pyspark.sql import functions as F

from vicinity.operators.polygons import points_in_polygons, primary_zone, tiles_of

SCHEMA = "polygon string, ord int, shared boolean, lat1 double, lng1 double, lat2 double, lng2 double"


def ring(name, order, corners, shared=False):
    return [(name, order, shared, *a, *b) for a, b in zip(corners, [*corners[1:], corners[0]]) if a != b]


def inside(edges, lat, lng):
    crossed = 0
    for _, _, _, lat1, lng1, lat2, lng2 in edges:
        if (lat1 <= lat < lat2) or (lat2 <= lat < lat1):
            crossed += lng1 + (lat - lat1) / (lat2 - lat1) * (lng2 - lng1) > lng
    return crossed % 2 == 1


def circle(lat, lng, radius, n, wave=0.0):
    turn = [2 * math.pi * k / n for k in range(n)]
    return [(lat + radius * (1 + wave * math.sin(9 * t)) * math.sin(t), lng + radius * (1 + wave * math.sin(9 * t)) * math.cos(t)) for t in turn]


def test_against_every_edge(spark):
    shapes = {
        "box": ring("box", 0, [(37.5, 127.0), (37.5, 127.25), (37.75, 127.25), (37.75, 127.0)]),
        "hole": ring("hole", 1, [(37.0, 126.5), (37.0, 127.5), (38.0, 127.5), (38.0, 126.5)]) + ring("hole", 1, [(37.4, 126.9), (37.6, 126.9), (37.6, 127.1), (37.4, 127.1)]),
        "star": ring("star", 2, circle(37.5, 127.0, 0.3, 700, 0.6), True),
        "small": ring("small", 3, circle(37.505, 127.01, 0.001, 50), True),
        "steps": ring("steps", 4, [(37.2 + 0.01 * (k // 2), 126.8 + 0.01 * ((k + 1) // 2)) for k in range(60)] + [(37.2, 127.1)]),
    }
    rng = random.Random(11)
    points = [(36.9 + 1.2 * rng.random(), 126.4 + 1.2 * rng.random()) for _ in range(600)]
    points += [(37.5 + 0.004 * (rng.random() - 0.5), 127.01 + 0.004 * (rng.random() - 0.5)) for _ in range(150)]
    points += [(37.5, 127.1), (37.4, 127.0), (37.55, 126.9), (37.6, 127.05), (37.21, 126.815), (80.0, 10.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(-1, None, 127.0)], "id long, lat double, lng double")
    edges = spark.createDataFrame([e for rows in shapes.values() for e in rows], SCHEMA)
    got = {r["id"]: [z["polygon"] for z in r["zones"]] for r in points_in_polygons(df, edges).collect()}
    order = ["box", "hole", "steps", "star", "small"]
    for k, (lat, lng) in enumerate(points):
        assert got[k] == [n for n in order if inside(shapes[n], lat, lng)], (lat, lng)
    assert got[-1] == [] and len(got) == len(points) + 1


def test_a_ring_of_100000_edges(spark):
    n = 100_000
    turn = F.col("id") * (2 * math.pi / n)
    at = lambda t: (F.sin(t) * 3 + 40, F.cos(t) * 3 + 10)
    (lat1, lng1), (lat2, lng2) = at(turn), at((F.col("id") + 1) % n * (2 * math.pi / n))
    edges = spark.range(n).select(F.lit("ring").alias("polygon"), F.lit(0).alias("ord"), F.lit(False).alias("shared"), lat1.alias("lat1"), lng1.alias("lng1"), lat2.alias("lat2"), lng2.alias("lng2"))
    tiles = tiles_of(edges).select(F.explode("zones").alias("z")).select(F.size("z.edges").alias("n"))
    most, rows = tiles.agg(F.max("n"), F.count("*")).first()
    assert most <= 4 * math.sqrt(n) and rows <= n
    points = spark.range(4000).select("id", (F.rand(1) * 8 + 36).alias("lat"), (F.rand(2) * 8 + 6).alias("lng"))
    far = F.hypot(F.col("lat") - 40, F.col("lng") - 10)
    located = primary_zone(points_in_polygons(points, edges)).where(F.abs(far - 3) > 1e-6)
    assert located.where((far < 3) != (F.col("match_count") == 1)).isEmpty()


def test_no_polygon(spark):
    df = spark.createDataFrame([(1, 37.5, 127.0)], "id long, lat double, lng double")
    assert points_in_polygons(df, spark.createDataFrame([], SCHEMA)).first()["zones"] == []
