"""Nearest places by the pyramid, on even and on very uneven maps, against brute force."""

import math
import random

from vicinity.operators.pyramid import nearest_places


def metres(a, b):
    lat1, lng1, lat2, lng2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return round(2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))


def compare(spark, sites, places, k, others=False):
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(sites)], "site_id long, lat double, lng double")
    p = spark.createDataFrame([(i, *q) for i, q in enumerate(places)], "poi_id long, lat double, lng double")
    rows = nearest_places(s, p, k, others=others).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["site_id"], r["rank"])):
        got.setdefault(r["site_id"], []).append((r["distance_m"], r["poi_id"]))
    for i, a in enumerate(sites):
        want = sorted((metres(a, b), j) for j, b in enumerate(places) if not (others and i == j))[:k]
        assert got.get(i, []) == want, (i, a)
    return {r["site_id"]: r["tested"] for r in rows}


def test_one_far_row_and_one_dense_town(spark):
    rng = random.Random(3)
    town = [(37.5 + rng.random() / 200, 127.0 + rng.random() / 200) for _ in range(2500)]
    country = [(35 + 3 * rng.random(), 126 + 3 * rng.random()) for _ in range(60)]
    places = town + country + [(0.0, 0.0)]
    sites = town[::50] + [(a + 0.003, b) for a, b in country[::3]] + [(37.51, 127.01), (37.49, 127.0), (10.0, 60.0)]
    tested = compare(spark, sites, places, 1)
    assert max(tested.values()) <= 30


def test_everywhere_on_the_globe(spark):
    rng = random.Random(5)
    places = [(math.degrees(math.asin(2 * rng.random() - 1)), 360 * rng.random() - 180) for _ in range(150)]
    places += [(90.0, 0.0), (-90.0, 50.0), (10.0, 179.999), (10.0, -179.999), (20.0, 20.0), (20.0, 20.0), (20.0, 20.0)]
    sites = [(math.degrees(math.asin(2 * rng.random() - 1)), 360 * rng.random() - 180) for _ in range(40)]
    compare(spark, sites + [(89.99, 180.0), (10.0, 180.0), (20.0, 20.0)], places, 3)
    compare(spark, places, places, 4, others=True)


def test_few_or_no_places(spark):
    assert compare(spark, [(1.0, 1.0), (2.0, 2.0)], [(1.0, 1.0)], 3) == {0: 1, 1: 1}
    assert compare(spark, [(1.0, 1.0)], [(1.0, 1.0)], 1, others=True) == {}
    s = spark.createDataFrame([(0, None, 1.0), (1, 5.0, float("nan")), (2, 5.0, 5.0)], "site_id long, lat double, lng double")
    none = spark.createDataFrame([(0, None, None)], "poi_id long, lat double, lng double")
    assert nearest_places(s, none).count() == 0
    assert [r["site_id"] for r in nearest_places(s, s.withColumnRenamed("site_id", "poi_id")).collect()] == [2]
