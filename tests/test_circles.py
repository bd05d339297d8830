"""Counts and nearest places inside circles against brute force, on even and uneven maps and in split tiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vicinity.operators import areas, baseline, circles, radius


def metres(a, b):
    lat1, lng1, lat2, lng2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def maps():
    rng = random.Random(8)
    town = [(37.5 + rng.gauss(0, 0.01), 127.0 + rng.gauss(0, 0.01)) for _ in range(500)]
    far = [(-33.87 + rng.random() / 50, 151.2 + rng.random() / 50) for _ in range(40)]
    north = [(69.6 + rng.random() / 20, 18.9 + rng.random() / 8) for _ in range(60)]
    zero = [(rng.random() / 50 - 0.01, rng.random() / 50 - 0.01) for _ in range(60)]
    pois = town + far + north + zero + town[:30] + [(37.5, 127.0)] * 15
    sites = town[::9] + far[::5] + north[::5] + zero[::5] + [(37.5, 127.0), (37.53, 127.0), (10.0, 10.0), (37.5 + 500 / 111194.92664, 127.0)]
    return sites, [(i, "abcd"[i % 4] if i % 7 else None, *p) for i, p in enumerate(pois)]


@pytest.fixture(scope="module")
def frames(spark):
    sites, pois = maps()
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(sites)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "site_id long, lat double, lng double")
    p = spark.createDataFrame([*pois, (9000, "a", None, 1.0), (9001, "a", float("nan"), 1.0)], "poi_id long, subtype string, lat double, lng double")
    return sites, pois, s, p


@pytest.fixture(params=["whole", "split"])
def tiles(request, monkeypatch):
    if request.param == "split":
        for name, value in (("SITES_AT_ONCE", 7), ("PLACES_AT_ONCE", 50), ("_BLOCK", 3), ("_PAIRS", 40)):
            monkeypatch.setattr(circles, name, value)


def test_counts(frames, tiles):
    sites, pois, s, p = frames
    for rounding, radii in (("before", [1, 300, 500, 3000]), ("after", [500, 1000])):
        got = {r["site_id"]: r for r in baseline.radius_counts(s, p, radii, rounding=rounding).collect()}
        assert got[900]["count_500m"] == got[901]["count_500m"] == 0 and len(got) == len(sites) + 2
        for i, a in enumerate(sites):
            raw = [metres(a, q[2:]) for q in pois]
            near = lambda m, r: (round(m) if rounding == "before" else m) <= r  # noqa: B023, E731
            assert [got[i][f"count_{r}m"] for r in radii] == [sum(near(m, r) for m in raw) for r in radii]
            assert got[i]["nearest_distance"] == min((round(m) for m in raw if near(m, max(radii))), default=None)


def test_kinds(frames, tiles):
    sites, pois, s, p = frames
    got = {r["site_id"]: r for r in baseline.subtype_counts(s, p, {"a": "a", "b": "b", "x": "x"}, 1500).collect()}
    for i, a in enumerate(sites):
        within = [(round(metres(a, q[2:])), q[1]) for q in pois if round(metres(a, q[2:])) <= 1500]
        assert (got[i]["a_count"], got[i]["x_count"], got[i]["total"]) == (sum(k == "a" for _, k in within), 0, len(within))
        assert got[i]["nearest_b"] == min((m for m, k in within if k == "b"), default=None) and got[i]["nearest_x"] is None


def test_nearest(frames, tiles):
    sites, pois, s, p = frames
    got = {}
    for r in radius.nearby_by_level(s, p, "subtype", 1500, 3).collect():
        got.setdefault((r["site_id"], r["subtype"]), []).append((r["rank"], r["distance_m"], r["poi_id"]))
    one = {r["site_id"]: (r["distance_m"], r["poi_id"], r["subtype"]) for r in radius.nearest_within(s, p, 1500, keep=("subtype",)).collect()}
    for i, a in enumerate(sites):
        within = [(round(metres(a, q[2:])), q[0], q[1]) for q in pois if round(metres(a, q[2:])) <= 1500]
        assert one.get(i) == min(within, default=None)
        for kind in ("a", "b", "c", "d", None):
            want = sorted(x[:2] for x in within if x[2] == kind)[:3]
            assert sorted(got.get((i, kind), [])) == [(k + 1, *x) for k, x in enumerate(want)]


def test_the_inside_of_a_circle_is_not_measured(monkeypatch):
    """30,000 places around each of 200 sites: what is measured grows with the rim."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    table = lambda n: pa.table({"lat": 37.5 + rng.random(n) / 20, "lng": 127 + rng.random(n) / 16})
    s, p = circles._Points(table(200)), circles._Points(table(40_000))
    tested = []
    chord = circles._Points.chord
    monkeypatch.setattr(circles._Points, "chord", lambda own, k, other, j: tested.append(len(j)) or chord(own, k, other, j))
    found = circles._counted(s, p, np.zeros(40_000, int), np.ones(40_000, int), 1, 2500, "before")[:, 0]
    assert sum(tested) < 0.2 * found.sum()
    full = [int((np.rint(circles._metres(chord(s, np.full(40_000, k), p, np.arange(40_000)))) <= 2500).sum()) for k in range(200)]
    assert found.tolist() == full


def test_kinds_that_nobody_listed(frames, tiles):
    sites, pois, s, p = frames
    got = {(r["site_id"], r["subtype"]): (r["count"], r["nearest_distance"], r["priority"]) for r in areas.subtype_chips(s, p, 1500, ["c"]).collect()}
    want = {}
    for i, a in enumerate(sites):
        for _, kind, *q in pois:
            if (m := round(metres(a, q))) <= 1500:
                n, near, place = want.get((i, kind or "기타"), (0, m, 1 if kind == "c" else 9999))
                want[i, kind or "기타"] = (n + 1, min(near, m), place)
    assert got == want


def test_lines(spark, frames, tiles):
    sites, pois, s, _ = frames
    stations = [(k, lat, lng, [str(k % 40), str(k % 3), None][: k % 4]) for k, _, lat, lng in pois]
    p = spark.createDataFrame(stations, "poi_id long, lat double, lng double, lines array<string>")
    got = {r["site_id"]: r for r in baseline.line_counts(s, p, (300, 1000)).collect()}
    for i, a in enumerate(sites):
        for r in (300, 1000):
            near = [x[3] for x in stations if round(metres(a, x[1:3])) <= r]
            want = (len({y for x in near for y in x if y}), sum(len(x) > 1 for x in near), len(near))
            assert tuple(got[i][f"{stem}_count_{r}m"] for stem in ("line", "transfer", "station")) == want
    assert got[900]["line_count_300m"] == 0


def test_routes_around(spark, frames, tiles):
    sites, pois, s, _ = frames
    rng = random.Random(1)
    stops = [(k, lat, lng) for k, _, lat, lng in pois]
    served = [(k, rng.choice([f"{n}" for n in range(150)] + [None])) for k, *_ in stops for _ in range(4)]
    kind = lambda name: "one" if len(name or "") == 1 else "two" if len(name or "") == 2 else None
    size = F.length("route_name")
    found = baseline.route_access(
        s, spark.createDataFrame(stops, "node_id long, lat double, lng double"), spark.createDataFrame(served, "node_id long, route_name string"),
        F.when(size == 1, "one").when(size == 2, "two"), ("one", "two"), radius_m=700, preview=5,
    )
    got = {r["site_id"]: r for r in found.collect()}
    for i, a in enumerate(sites):
        near = {k for k, *q in stops if metres(a, q) <= 700}
        names = sorted({n for k, n in served if k in near}, key=lambda n: (n is not None, n or ""))
        kinds = [sum(kind(n) == t for n in names) for t in ("one", "two")]
        assert [got[i][c] for c in ("route_count", "one_count", "two_count")] == [len(names), *kinds]
        assert got[i]["available_routes"] == (", ".join(n for n in names[:5] if n) if names else None)


def test_lists_are_kept(spark, frames):
    _, pois, s, p = frames
    listed = p.withColumn("marks", F.array(F.lit("a"), F.coalesce("subtype", F.lit("-"))))
    got = radius.nearest_within(s, listed, 300, keep=("marks",)).where("site_id = 0").first()
    assert got["marks"] == ["a", pois[got["poi_id"]][1] or "-"]
