"""Operators against literal vectors and brute force on small tables."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vicinity.functions import display, rules, text as tx
from vicinity.functions.geo import projected_to_wgs84
from vicinity.functions.similarity import similar_pairs
from vicinity.operators import deals, graph, grid, matching, radius, ranking, scoring, search, stations
from vicinity.plans import jobs


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    h += math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("x")).first()["x"]


# --- Scores -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("direction,target,pct,score", [("lower", 0, 40, 60), ("lower", 5, 90, 10), ("higher", 5, 10, 90)])
def test_mid_rank_vectors(spark, direction, target, pct, score):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.0, 0.0, 0.0, 5.0)], "v double")
    row = scoring.mid_rank(df, "v", direction).where(F.col("v") == target).first()
    assert (row["pct"], row["score"]) == (pct, score)


def test_missing_values_are_no_population(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, 2.0)], "k int, v double")
    got = {r["k"]: r["pct"] for r in scoring.mid_rank(df, "v", "lower").collect()}
    assert got == {1: 25.0, 2: None, 3: None, 4: None, 5: 75.0}
    assert scoring.mid_rank(df.where("k in (2, 3)"), "v", "lower").where("pct is not null").count() == 0


def test_scores_average_fifty_and_ranges_agree(spark):
    rng = random.Random(7)
    rows = [(k % 3, float(rng.randint(0, 40)) if k % 2 else rng.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double")
    assert abs(scoring.mid_rank(df, "v", "higher").agg(F.avg("score")).first()[0] - 50) < 0.01
    hist = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for by in ((), ("g",)):
        h = hist if by else df.groupBy("v").agg(F.count("*").alias("n"))
        plain = scoring.running_count(h, "v", "n", by)
        ranged = scoring.running_count(h, "v", "n", by, one_task_rows=10)
        key = [*by, "v", "n", "below", "total"]
        assert sorted(map(tuple, plain.select(key).collect())) == sorted(map(tuple, ranged.select(key).collect()))


@pytest.mark.parametrize("values,probe,direction,top", [([0, 0, 0, 0, 5], 0, "higher", 60), ([100, 100, 200, 300], 100, "lower", 25), ([], 1, "lower", None)])
def test_probe_top_percent(spark, values, probe, direction, top):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probes = spark.createDataFrame([(float(probe),)], "probe double")
    assert scoring.probe_top_percent(df, "v", probes, direction).first()["top_percent"] == top


def test_number_parse(spark):
    assert [one(spark, tx.number("c"), c=v) for v in ("nan", "inf", "", "12.5", "1,200")] == [None, None, None, 12.5, 1200.0]


def test_constant_breaks_give_zero(spark):
    assert one(spark, scoring.percentile_of("v", [3.0] * 101), v=3.0) == 0
    assert one(spark, scoring.percentile_of("v", [0.0, 1.0, 2.0]), v=9.0) == 100


def test_weighted_score_skips_missing(spark):
    scores = F.create_map(F.lit("a"), F.lit(80.0), F.lit("b"), F.lit(61.0))
    assert one(spark, ranking.weighted_score(scores, {"a": 1, "b": 1, "c": 5, "d": 0})) == 70
    assert one(spark, ranking.weighted_score(scores, {"c": 5, "a": -1})) == 0


# --- Distances --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(3)
    point = lambda: (37.4 + rng.random() * 0.1, 126.8 + rng.random() * 0.1)
    sites = [(k, *point()) for k in range(40)] + [(40, -33.0, 151.0), (41, 0.0005, 0.0005), (42, 64.1, -21.9)]
    pois = [(k, *point()) for k in range(300)] + [(300, -33.01, 151.01), (301, -0.0005, -0.0005), (302, 64.11, -21.93)]
    pois += [(303 + k, *pois[0][1:]) for k in range(50)]
    return sites, pois, spark.createDataFrame(sites, "site_id int, lat double, lng double"), spark.createDataFrame(pois, "poi_id int, lat double, lng double")


@pytest.mark.parametrize("r,replicate,salt", [(300, "sites", 1), (1500, "sites", 3), (1500, "pois", 1), (800, "pois", 2), (9000, "sites", 1)])
def test_radius_join_is_brute_force(places, r, replicate, salt):
    sites, pois, s, p = places
    want = sorted((a[0], b[0], metres(a[1:], b[1:])) for a in sites for b in pois if metres(a[1:], b[1:]) <= r)
    got = radius.radius_join(s, p, r, replicate=replicate, salt=salt).select("site_id", "poi_id", "distance_m")
    assert sorted(map(tuple, got.collect())) == want


def test_nearest_and_knn_reach_everything(places):
    sites, pois, s, p = places
    want = {a[0]: min((metres(a[1:], b[1:]), b[0]) for b in pois) for a in sites}
    got = {r["site_id"]: (r["distance_m"], r["poi_id"]) for r in radius.nearest(s, p).collect()}
    assert got == want
    near = {a[0]: sorted((metres(a[1:], b[1:]), b[0]) for b in sites if b[0] != a[0])[:3] for a in sites}
    got = {}
    for r in radius.knn(s, 3).orderBy("site_id", "rank").collect():
        got.setdefault(r["site_id"], []).append((r["distance_m"], r["neighbour_id"]))
    assert got == near


def test_nearest_of_nothing(places):
    _, _, s, p = places
    assert radius.nearest(s, p.limit(0)).count() == 0


def test_projection_origin(spark):
    for epsg, north in ((5181, 500000.0), (5186, 600000.0)):
        row = projected_to_wgs84(spark.createDataFrame([(200000.0, north)], "x double, y double"), "x", "y", epsg).first()
        assert row["lat"] == pytest.approx(38, abs=1e-8) and row["lng"] == pytest.approx(127, abs=1e-8)
    row = projected_to_wgs84(spark.createDataFrame([(200000.0, 450000.0)], "x double, y double"), "x", "y", 5174).first()
    assert 0.002 < row["lat"] - 37.5495 < 0.004 and -0.003 < row["lng"] - 127.0028902 < -0.001


# --- Grid -------------------------------------------------------------------------------------------
def _components(cells):
    left, sizes = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        stack, found = [start], []
        left.discard(start)
        while stack:
            i, j = stack.pop()
            found.append((i, j))
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
        for c in found:
            sizes[c] = min(found)
    return sizes


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_components_match_flood_fill(spark, tile):
    rng = random.Random(11)
    cells = {(i - 5, j - 5) for i in range(30) for j in range(30) if rng.random() < 0.58}
    cells |= {(60, j) for j in range(40)}
    shuffled = sorted(cells, key=lambda c: rng.random())
    want = _components(cells)
    df = spark.createDataFrame(shuffled, "i int, j int")
    got = {(r["i"], r["j"]): r["cid"] for r in graph.components(df, tile).collect()}
    assert got == {c: (root[0] << 31) + root[1] + (1 << 30) for c, root in want.items()}


def test_border_distance_matches_spreading(spark):
    rng = random.Random(5)
    box = (-3, 20, -2, 25)
    inside = {(i, j) for i in range(0, 18) for j in range(1, 23) if rng.random() < 0.93}
    dist = {(i, j): 0 for i in range(box[0], box[1] + 1) for j in range(box[2], box[3] + 1) if (i, j) not in inside}
    queue = list(dist)
    for c in queue:
        for n in ((c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)):
            if n in inside and n not in dist:
                dist[n] = dist[c] + 1
                queue.append(n)
    found = graph.border_distance(spark.createDataFrame(sorted(inside), "i int, j int"), box)
    assert {(r["i"], r["j"]): r["border_m"] for r in found.collect()} == {c: 100 * v for c, v in dist.items()}


def test_upper_median(spark):
    rows = [(1, v) for v in (5, 1, 9, 3)] + [(2, 4)] + [(3, v) for v in (7, 7, 2)]
    got = grid.upper_median(spark.createDataFrame(rows, "cid int, distance_m int")).collect()
    assert {r["cid"]: r["median_distance_m"] for r in got} == {1: 5, 2: 4, 3: 7}


def test_coarser_points_keep_their_sum(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-9, 9), rng.randint(-9, 9), "x", "s", 1.0) for _ in range(200)]
    cell = spark.createDataFrame(rows, "i int, j int, layer string, subtype string, count double")
    g = grid.Grid(zone=cell.select("i", "j"), cell=cell)
    for factor in (1, 3, 9):
        assert grid.cell_values(g, "x", "point", factor).agg(F.sum("value")).first()[0] == 200
    assert grid.cell_values(g, "x", "point", 9).agg(F.min("gi")).first()[0] == -1


# --- Names ------------------------------------------------------------------------------------------
def test_similar_pairs_finds_all(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("가나다라abc12") for _ in range(rng.randint(2, 9)))
    a, b = sorted({word() for _ in range(80)}), sorted({word() for _ in range(80)})
    a += ["은마아파트1", "ab"]
    b += ["은마아파트2", "ba"]
    want = {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= 0.6}
    left = spark.createDataFrame([("k", x) for x in a], "k string, x string")
    right = spark.createDataFrame([("k", y) for y in b], "k string, y string")
    got = similar_pairs(left, right, "x", "y", ("k",), 0.6)
    assert {(r["x"], r["y"]) for r in got.collect()} == want


def test_containment_join_finds_all(spark):
    names = ["가", "가나", "가나다라", "다라", "라마바사", "가나다라마바사", "나다"]
    left = spark.createDataFrame([(x,) for x in names[:5]], "a string")
    right = spark.createDataFrame([(x,) for x in names[1:]], "b string")
    got = search.containment_join(left, right, "a", "b", shortest=2)
    want = sorted((x, y) for x in names[:5] for y in names[1:] if len(x) > 1 and len(y) > 1 and (x in y or y in x))
    assert sorted(map(tuple, got.select("a", "b").collect())) == want


def test_name_rules(spark):
    norm = lambda s: one(spark, tx.normalize_name("c"), c=s)
    assert norm("래미안(1차) 강남 아파트") == "래미안강남"
    assert norm("Ｈ하우스Ⅱ[공공]") == "h하우스ii"
    assert one(spark, tx.strip_dong(F.lit("대치은마"), F.lit("대치동"))) == "은마"
    assert one(spark, tx.number_conflict(F.lit("은마1단지"), F.lit("은마02단지")))
    assert not one(spark, tx.number_conflict(F.lit("은마2단지"), F.lit("은마02단지")))
    assert one(spark, tx.only_generic(F.lit("래미안자이가"), F.lit("청구한라비발디")))


def _site(k, name, road=None, bonbun=None, gu="g", dong="d동", rental=False):
    return (k, name, gu, dong, road, None, None, bonbun, None, bonbun, rental)


SITE_SCHEMA = (
    "site_id int, name string, gu string, dong string, road_address string, road_name string, road_detail string, bonbun string, "
    "bubun string, jibun string, is_rental boolean"
)
DEAL_SCHEMA = "apartment_name string, gu string, dong string, road_name string, road_address string, bonbun string, bubun string, transaction_type string"


def test_cascade_and_mapping(spark):
    sites = [
        _site(1, "은마", "서울특별시 g 길 1"), _site(2, "한빛마을", "서울특별시 g 길 2"), _site(3, "하늘정원", bonbun="7"), _site(4, "푸른숲마을단지", bonbun="8"),
        _site(5, "별빛타운"), _site(6, "별빛타운2차"), _site(7, "없는곳"), _site(8, "공공은마", "서울특별시 g 길 1", rental=True), _site(9, "확정"),
    ]
    deals_rows = [
        ("은마", "g", "d동", None, "서울시 g 길 1", "1", None, "trade"), ("한빛", "g", "d동", None, "서울시 g 길 2", "2", None, "trade"),
        ("한빛마을2", "g", "d동", None, "서울시 g 길 2", "3", None, "rent"), ("하늘정원", "g", "d동", None, None, "7", None, "rent"),
        ("전혀다름", "g", "d동", None, None, "7", None, "rent"), ("푸른숲마을단치", "g", "d동", None, None, "8", None, "trade"),
        ("별빛타운", "g", "d동", None, None, "9", None, "trade"),
    ]
    keyed = matching.prepare_sites(spark.createDataFrame(sites, SITE_SCHEMA))
    cands = matching.candidates(spark.createDataFrame(deals_rows, DEAL_SCHEMA))
    got = {r["site_id"]: (r["match_type"], r["match_confidence"], r["cand_name"]) for r in matching.cascade(keyed, cands).collect()}
    assert got[1] == ("road_address_exact", 0.98, "은마")
    assert got[2] == ("road_address_exact_score_verified", 0.86, "한빛마을2")
    assert got[3] == ("gu_dong_jibun_exact_name_confirmed", 0.96, "하늘정원")
    assert got[5] == ("gu_dong_name_exact_candidate", 0.72, "별빛타운")
    assert got[6] == ("same_dong_contains_candidate", 0.78, "별빛타운")
    assert got[7] == ("unmatched", 0.0, None)
    alias = matching.alias_approvals(keyed, cands).collect()
    assert [(r["site_id"], r["cand_norm"]) for r in alias] == []
    fixed = spark.createDataFrame([(9, "손으로", None, None)], "site_id int, cand_name string, cand_road string, cand_jibun string")
    reject = spark.createDataFrame([(5, "별빛 타운")], "site_id int, cand_name string")
    rows = {r["site_id"]: r for r in matching.match_sites(keyed, cands, fixed, reject).collect()}
    shown = lambda k: (rows[k]["match_type"], rows[k]["match_confidence"], rows[k]["verified"])
    assert shown(1) == ("road_address_exact", 0.98, "Y")
    assert shown(3) == ("gu_dong_jibun_exact_name_confirmed_risk_review", 0.60, "N")
    assert shown(5) == ("manual_reject_excluded", 0.0, "N")
    assert shown(8) == ("rental_tenure_mismatch", 0.0, "N")
    assert shown(9) == ("manual_alias", 1.0, "Y") and rows[9]["manual_override"] == "Y"


# --- Others -----------------------------------------------------------------------------------------
def test_station_clusters_follow_row_order(spark):
    rng = random.Random(4)
    rows = [(k, str(k), f"역{k % 5}", f"{k % 3}호선", 37.5 + rng.random() * 0.012, 127 + rng.random() * 0.012) for k in range(80)]
    clusters = []
    for _, sid, name, line, lat, lng in rows:
        home = next((c for c in clusters if c["name"] == name and metres((c["lat"], c["lng"]), (lat, lng)) <= 350), None)
        if home is None:
            home = {"name": name, "lat": lat, "lng": lng, "n": 0, "lines": set()}
            clusters.append(home)
        home["n"] += 1
        home["lat"] = (home["lat"] * (home["n"] - 1) + lat) / home["n"]
        home["lng"] = (home["lng"] * (home["n"] - 1) + lng) / home["n"]
        home["lines"].add(line)
    want = sorted((c["name"], c["n"], round(c["lat"], 9), tuple(sorted(c["lines"]))) for c in clusters)
    df = spark.createDataFrame(rows, "ord int, station_id string, name string, line string, lat double, lng double")
    got = [(r["name"], r["n"], round(r["lat"], 9), tuple(r["lines"])) for r in stations.cluster_stations(df).collect()]
    assert sorted(got) == want


def test_exact_name_beats_substring_and_gu_narrows(spark):
    rows = [(1, "신동아", "a", "x"), (2, "신동아1차", "a", "x"), (3, "신동아", "b", "y")]
    sites = spark.createDataFrame(rows, "site_id int, name string, gu string, dong string")
    assert search.resolve_site(sites, "신동아").first()["site_id"] == 1
    assert search.resolve_site(sites, "신동아", "b").first()["site_id"] == 3
    assert search.resolve_site(sites, "동아1").first()["site_id"] == 2
    assert search.resolve_site(sites, "신동아", "zzz").first()["site_id"] == 1
    assert search.resolve_site(sites, "없음").count() == 0


def test_displays(spark):
    assert one(spark, display.money_text("v"), v=125000.0) == "12.5억"
    assert one(spark, display.money_text("v"), v=9500.0) == "9,500만원"
    assert one(spark, rules.bus_type("v"), v="9401") == "express"
    assert one(spark, F.array_join(display.deal_months(F.lit("2024-02-10").cast("date")), ",")) == "202402,202401,202312"


def test_run_jobs_isolates_failures(spark):
    def broken():
        raise ValueError("no file")

    report = jobs.run_jobs(spark, {"good": lambda: spark.range(3), "bad": broken, "later": lambda: spark.range(1)}).collect()
    assert [(r["job"], r["status"], r["rows"]) for r in report] == [("good", "success", 3), ("bad", "failed", None), ("later", "success", 1)]
    assert "no file" in report[1]["error"]


def test_latest_and_cap(spark):
    rows = [(1, k, "trade", "sale", f"2024-01-{k + 1:02d}", 100 + k, None, None, 84.0, 1) for k in range(5)]
    schema = "site_id int, deal_key int, transaction_type string, filter_type string, d string, deal_amount long, deposit_amount long, monthly_rent long, area_m2 double, floor int"
    df = spark.createDataFrame(rows, schema).withColumn("deal_date", F.col("d").cast("date"))
    assert deals.latest_deals(df).first()["deal_amount"] == 104
    assert [r["deal_amount"] for r in deals.capped_deals(df, 2).orderBy("rank").collect()] == [104, 103]


def test_registries(spark):
    from vicinity.plans import registries

    assert registries.layer_table(spark).count() == 10
    assert registries.metric_table(spark).where("ranked").count() == 18
    assert registries.layer_radius(["cctv"]) == {"cctv": 200}
    with pytest.raises(ValueError):
        registries.layer_radius(["academy", "cafe"])


def test_baseline_jobs_write_and_check(spark, tmp_path):
    from vicinity.operators import quality
    from vicinity.plans.registries import CATEGORIES

    sites = spark.createDataFrame([(1, "a", "g", "d", 37.5, 127.0), (2, "b", "g", "d", 37.52, 127.0)], "site_id int, name string, gu string, dong string, lat double, lng double")
    places = spark.createDataFrame([(1, "스타벅스", "스타벅스", 37.5001, 127.0), (2, "이디야", "이디야", 37.5002, 127.0)], "poi_id int, name string, subtype string, lat double, lng double")
    report = jobs.run_jobs(spark, jobs.baseline_jobs(sites, {"cafe": places, "park": places}, str(tmp_path)))
    assert {(r["job"], r["status"], r["rows"]) for r in report.collect()} == {("cafe", "success", 2), ("park", "success", 2)}
    cafe = spark.read.parquet(str(tmp_path / "cafe"))
    got = {r["site_id"]: (r["cafe_access_raw"], r["cafe_access_raw_score"]) for r in cafe.collect()}
    assert got == {1: (6, 75.0), 2: (0, 25.0)}
    checks = quality.dq_checks(cafe, CATEGORIES["cafe"].spec())
    assert checks.where("level = 'ERROR'").count() == 0
    far = {r["site_id"]: r["nearest_distance"] for r in spark.read.parquet(str(tmp_path / "park")).collect()}
    assert far[1] == 11 and far[2] > 2000


def test_site_insights(spark):
    from vicinity.operators import insights, ranking

    counts = "transfer_count_1km nightlife_count_500m academy_count bus_count cafe_count kids_count show_count general_hospital_count warehouse_count night_pharmacy_count mart_count starbucks_count bike_count ev_count culture_count".split()
    far = ["subway_distance", "emergency_distance", "riverside_distance"]
    row = {"site_id": 1, "subway_lines": ["2호선"], **dict.fromkeys(counts, 0), **dict.fromkeys(far, 400.0)}
    rows = [row | {"academy_count": 60, "bus_count": 5, "cafe_count": 5}, row | {"site_id": 2, "transfer_count_1km": 1, "nightlife_count_500m": 12}]
    wide = spark.createDataFrame(rows)
    first, second = ranking.CATEGORY_ORDER[0], ranking.CATEGORY_ORDER[1]
    pct = spark.createDataFrame([(1, second, 1.0), (1, first, 20.0), (1, "nightlife", 90.0)], "site_id long, category string, pct double")
    one, two = insights.site_insights(wide, pct).orderBy("site_id").collect()
    assert one["lifestyles"] == ["도보생활형", "의료안심형", "생활편의형", "휴식형"]
    assert one["strengths"] == [first, second] and one["cautions"] == []
    assert two["strengths"] == ["transfer"] and two["cautions"] == ["nightlife_dense"]
