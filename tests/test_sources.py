"""Sources and sinks on files made by the tests."""

import datetime
import json

from pyspark.sql import functions as F

from vicinity.operators import deals, polygons, snapshots
from vicinity.sources import csv, deal_files, geojson, sinks, xml


def test_csv_encodings_and_leading_zeros(spark, tmp_path):
    text = "이름,번호,값\n한강,0411,1.5\n마포,nan,x\n"
    for encoding in ("utf-8-sig", "cp949", "utf-8"):
        folder = tmp_path / encoding
        folder.mkdir()
        (folder / "a.csv").write_bytes(text.encode(encoding))
        raw = csv.read_csv_raw(spark, str(folder)).collect()
        assert [r["번호"] for r in raw] == ["0411", "nan"]
        rows = csv.read_csv_any(spark, str(folder), "`이름` string, `번호` string, `값` double").collect()
        assert [tuple(r) for r in rows] == [("한강", "0411", 1.5), ("마포", None, None)]


def test_xml_items(spark, tmp_path):
    body = "<response><items><item><statId>A1</statId><lat>37.5</lat></item><item><statNm>역</statNm></item></items></response>"
    (tmp_path / "c.xml").write_text(body, encoding="utf-8")
    rows = xml.read_xml_items(spark, str(tmp_path / "c.xml")).select("statId", "statNm", "lat").collect()
    assert sorted(map(tuple, rows), key=str) == [("A1", None, "37.5"), (None, "역", None)]


def test_geojson_polygons_and_holes(spark, tmp_path):
    square = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    hole = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
    far = [[20, 20], [21, 20], [21, 21], [20, 21], [20, 20]]
    made = {
        "type": "FeatureCollection",
        "features": [
            {"properties": {"name": "ring"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
            {"properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[far], [hole]]}},
        ],
    }
    (tmp_path / "g.json").write_text(json.dumps(made))
    edges = geojson.read_edges(spark, str(tmp_path / "g.json")).withColumn("shared", F.lit(False))
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 20.5, 20.5), (4, 50.0, 50.0)], "id int, lat double, lng double")
    found = polygons.points_in_polygons(points, edges, strip_deg=0.5)
    got = {r["id"]: [z["polygon"] for z in r["zones"]] for r in found.collect()}
    assert got == {1: ["ring"], 2: ["two"], 3: ["two"], 4: []}
    assert geojson.boundary_rings(geojson.read_polygons(spark, str(tmp_path / "g.json"))).count() == 4


def test_deal_files(spark, tmp_path):
    head = "시군구,번지,본번,부번,단지명,전용면적(㎡),계약년월,계약일,거래금액(만원),층,건축년도,도로명,주택유형"
    rows = [
        '서울특별시 강남구 대치동,12-3,0012,0003,은마,84.43,202401,5,"215,000",3,1979,삼성로 212,아파트',
        '서울특별시 강남구 대치동,12-3,0012,0003,은마,84.43,202401,5,"215,000",3,1979,삼성로 212,아파트',
        "서울특별시 강남구 대치동,,0007,0000,빌라,59.9,202402,,90000,1,2001,-,연립다세대",
        ",,,,,,,,,,,,",
    ]
    (tmp_path / "trade_2024.csv").write_text("안내\n□ 본 자료는\n" + head + "\n" + "\n".join(rows) + "\n", encoding="utf-8")
    rent = "NO,시군구,단지명,전용면적(㎡),계약년월,계약일,보증금(만원),월세금(만원),층,도로명\n"
    rent += 'NO,,,,,,,,,\n1,서울특별시 중구 신당동,남산,59.5,202312,31,"10,000",50,7,다산로 1\n2,서울특별시 중구 신당동,남산,59.5,202301,1,"30,000",0,7,다산로 1\n'
    (tmp_path / "list.csv").write_text("x\n" * 12 + rent, encoding="utf-8")
    raw = deal_files.read_deals(spark, str(tmp_path))
    found = deals.dedupe(deals.normalise(raw, 2023)).orderBy("deal_date").collect()
    got = [(r["deal_type"], r["gu"], r["dong"], r["apartment_name"], r["deal_date"], r["deal_amount"], r["deposit_amount"], r["monthly_rent"]) for r in found]
    assert got == [
        ("전세", "중구", "신당동", "남산", datetime.date(2023, 1, 1), None, 30000, 0),
        ("월세", "중구", "신당동", "남산", datetime.date(2023, 12, 31), None, 10000, 50),
        ("매매", "강남구", "대치동", "은마", datetime.date(2024, 1, 5), 215000, None, None),
    ]
    assert found[2]["bonbun"] == "12" and found[2]["bubun"] == "3"
    assert found[2]["road_address"] == "서울특별시 강남구 삼성로 212"
    assert {r["source_year"] for r in raw.collect()} == {"2024", "2023"}


def test_sinks(spark, tmp_path):
    sites = spark.createDataFrame([("a", 1, [{"d": 1}]), ("b", 2, [])], "name string, n int, items array<map<string,int>>")
    sinks.write_baseline(sites, str(tmp_path), "base", csv=True)
    assert sinks.baseline_columns(spark, str(tmp_path), "base", ["n"]).columns == ["n"]
    assert spark.read.option("header", True).csv(str(tmp_path / "base_csv")).count() == 2
    payloads = spark.createDataFrame([(f"site {k}", f"{{{k}}}") for k in range(50)], "name string, payload string")
    sinks.write_detail_shards(payloads, str(tmp_path / "shards"))
    assert sinks.read_detail(spark, str(tmp_path / "shards"), "site 7").first()["payload"] == "{7}"
    assert sinks.manifest(spark, str(tmp_path / "shards")).count() == 50


def test_snapshots_are_added_once_per_date(spark, tmp_path):
    cells = spark.createDataFrame([("bus", 1, 2, 3.0), ("bus", 1, 3, 1.0)], "layer string, i int, j int, count double")
    path = str(tmp_path / "history")
    assert snapshots.append_snapshot(cells, path, "2024-01-01")
    assert not snapshots.append_snapshot(cells, path, "2024-01-01")
    assert snapshots.append_snapshot(cells.limit(1), path, "2024-01-02")
    listed = snapshots.list_snapshots(spark.read.parquet(path)).orderBy("taken_on").collect()
    assert [(r["layers"], r["pois"]) for r in listed] == [(1, 4.0), (1, 3.0)]
