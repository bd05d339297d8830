"""Streams give what the same rows give in a batch."""

import json

import pytest
from pyspark.sql import functions as F

from vicinity.operators import events, snapshots
from vicinity.streaming import clicks


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _click(ts, kind, ip="1.1.1.1", agent="Mozilla/5.0", combo="gu=a"):
    return {"ts": ts, "event_type": kind, "ip": ip, "user_agent": agent, "combo_key": combo, "result_count": 3}


ROWS = [
    _click("2024-01-01T10:00:00Z", "page_view"), _click("2024-01-01T16:00:00Z", "page_view", "2.2.2.2"),
    _click("2024-01-01T17:00:00Z", "explore_search"), _click("2024-01-02T01:00:00Z", "explore_search", combo="gu=b"),
    _click("2024-01-02T02:00:00Z", "page_view", agent="Googlebot/2.1"), _click("2024-01-02T03:00:00Z", "page_view", "9.9.9.9"),
]


def test_written_events_equal_the_batch(spark, tmp_path):
    _write(tmp_path / "in", "a.json", ROWS[:3])
    _write(tmp_path / "in", "b.json", ROWS[3:])
    stream = clicks.event_stream(clicks.read_clicks(spark, str(tmp_path / "in"), files_per_batch=1), "seed", ["9.9.9.9"])
    clicks.write_events(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "out"))
    batch = clicks.event_stream(spark.read.schema(clicks.CLICK_SCHEMA).json(str(tmp_path / "in")), "seed", ["9.9.9.9"])
    shown = lambda df: sorted(tuple(map(str, r)) for r in events.daily(df).collect())
    assert written.count() == 4 and shown(written) == shown(batch)
    assert "ip" not in written.columns
    again = clicks.event_stream(clicks.read_clicks(spark, str(tmp_path / "in")), "seed", ["9.9.9.9"])
    clicks.write_events(again, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_running_sums(spark, tmp_path):
    _write(tmp_path / "in", "a.json", ROWS)
    stream = clicks.event_stream(clicks.read_clicks(spark, str(tmp_path / "in")), "seed")
    for name, df in (("kpis", clicks.daily_kpis(stream)), ("combos", clicks.combo_counts(stream))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    kpis = {str(r["day"]): (r["page_views"], r["searches"], r["visitors"]) for r in spark.table("kpis").collect()}
    assert kpis == {"2024-01-01": (1, 0, 1), "2024-01-02": (2, 2, 3)}
    assert {r["combo_key"]: r["count"] for r in spark.table("combos").collect()} == {"gu=a": 1, "gu=b": 1}


def test_late_rows_are_dropped(spark, tmp_path):
    _write(tmp_path / "in", "a.json", [_click("2024-01-10T10:00:00Z", "page_view")])
    stream = lambda: clicks.daily_kpis(clicks.event_stream(clicks.read_clicks(spark, str(tmp_path / "in")), "seed"))
    run = lambda: (
        stream().writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    )
    run()
    _write(tmp_path / "in", "b.json", [_click("2024-01-01T10:00:00Z", "page_view"), _click("2024-01-15T10:00:00Z", "page_view")])
    run()
    _write(tmp_path / "in", "c.json", [_click("2024-01-20T10:00:00Z", "page_view")])
    run()
    days = {str(r["day"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert days == {"2024-01-10", "2024-01-15"}


def test_snapshots_accumulate(spark, tmp_path):
    cells = spark.createDataFrame(
        [("2024-01-01", "bus", 1, 1, 2.0), ("2024-01-01", "bus", 1, 1, 1.0), ("2024-01-02", "bus", 1, 1, 5.0)],
        "taken_on string, layer string, i int, j int, count double",
    ).withColumn("taken_on", F.col("taken_on").cast("date"))
    cells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
    clicks.accumulate_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    listed = snapshots.list_snapshots(spark.read.parquet(str(tmp_path / "out"))).orderBy("taken_on").collect()
    assert [r["pois"] for r in listed] == [3.0, 5.0]


def test_a_date_in_two_batches_and_a_replay(spark, tmp_path):
    """Both files of a date count, each in a micro-batch of its own; running again adds nothing."""
    source = tmp_path / "in"
    for k, count in enumerate((2, 40)):
        spark.createDataFrame([("2024-01-01", "cafe", 1, 1, count)], "taken_on string, layer string, i int, j int, count long").coalesce(1).write.mode("append").parquet(str(source))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        stream = spark.readStream.schema("taken_on string, layer string, i int, j int, count long").option("maxFilesPerTrigger", 1).parquet(str(source))
        clicks.accumulate_snapshots(stream, out, check).awaitTermination(120)
    assert [r["count"] for r in snapshots.read_snapshots(spark, out).collect()] == [42]


def test_closed_days_count_visitors_exactly(spark, tmp_path):
    """Late rows within the watermark count, later ones don't, and a restart in between changes nothing."""
    path = str(tmp_path / "out")

    def run(name, rows):
        _write(tmp_path / "in", name, rows)
        days = clicks.closed_days(clicks.event_stream(clicks.read_clicks(spark, str(tmp_path / "in"), files_per_batch=1), "seed"))
        query = days.writeStream.format("parquet").outputMode("append").option("path", path)
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)

    day = [{**_click(f"2024-01-10T{k % 12:02d}:30:00Z", "page_view"), "ip": f"10.0.{k % 300}.1"} for k in range(1000)]
    run("a.json", day)
    late = [{**_click("2024-01-10T11:00:00Z", "page_view"), "ip": f"10.0.{k}.1"} for k in (5, 700)]
    run("b.json", [*late, {**_click("2024-01-11T12:00:00Z", "page_view"), "ip": "10.0.1.1"}])
    run("c.json", [_click("2024-01-14T12:00:00Z", "page_view")])
    run("d.json", [{**_click("2024-01-10T11:00:00Z", "page_view"), "ip": "10.9.9.9"}])
    run("e.json", [_click("2024-01-25T12:00:00Z", "page_view")])
    got = {str(r["day"]): (r["page_views"], r["visitors"]) for r in spark.read.parquet(path).collect()}
    assert got == {"2024-01-10": (1002, 301), "2024-01-11": (1, 1), "2024-01-14": (1, 1)}


def test_a_crash_before_the_commit_and_both_writers_in_one_folder(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    kind = "layer string, i int, j int, count long"
    cells = spark.createDataFrame([("cafe", 1, 1, 5), ("cafe", 1, 2, 1)], kind)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "commit", crash)
        with pytest.raises(RuntimeError):
            snapshots.append_snapshot(cells, path, "2024-01-01")
    assert not snapshots.has_snapshot(spark, path, "2024-01-01") and snapshots.read_snapshots(spark, path).isEmpty()
    assert snapshots.append_snapshot(cells.where("j = 1"), path, "2024-01-01")
    assert not snapshots.append_snapshot(cells, path, "2024-01-01")
    dated = [("2024-01-01", "cafe", 1, 1, 40), ("2024-01-02", "bus", 3, 3, 7)]
    spark.createDataFrame(dated, f"taken_on string, {kind}").selectExpr("cast(taken_on AS date) AS taken_on", "layer", "i", "j", "count").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(f"taken_on date, {kind}").parquet(str(tmp_path / "in"))
        clicks.accumulate_snapshots(stream, path, str(tmp_path / "check")).awaitTermination(120)
    got = {(str(r["taken_on"]), r["layer"], r["j"]): r["count"] for r in snapshots.read_snapshots(spark, path).collect()}
    assert got == {("2024-01-01", "cafe", 1): 45, ("2024-01-02", "bus", 3): 7}
    assert snapshots.append_snapshot(cells, path, "2024-01-03") and not snapshots.append_snapshot(cells, path, "2024-01-02")
    assert sorted(str(r["taken_on"]) for r in snapshots.list_snapshots(snapshots.read_snapshots(spark, path)).collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_missing_district_does_not_win(spark):
    from vicinity.operators import search

    sites = spark.createDataFrame([(1, "Park", None, None), (2, "Park", "A", "B")], "site_id int, name string, gu string, dong string")
    assert search.resolve_site(sites, "Park", "A", "B").first()["site_id"] == 2


def test_charger_station_is_one_real_row(spark):
    from vicinity.operators import stations

    rows = [("S", "B side", "addr2", 37.6, 126.9), ("S", "A side", "addr9", 37.5, 127.1)]
    df = spark.createDataFrame(rows, "station_id string, name string, address string, lat double, lng double").selectExpr(
        "*", "'op' AS operator", "'' AS use_time", "'01' AS kind", "true AS fast", "false AS restricted", "true AS free", "true AS available"
    )
    row = stations.charger_stations(df).first()
    assert (row["name"], row["address"], row["lat"], row["lng"], row["charger_count"]) == ("A side", "addr9", 37.5, 127.1, 2)


def test_wide_deal_files_keep_all_cells(spark, tmp_path):
    from vicinity.sources import deal_files

    names = ["시군구", "번지", "단지명"] + [f"x{k}" for k in range(70)] + ["층"] + ['계약년월']
    (tmp_path / "apt_trade.csv").write_text(",".join(names) + "\n" + ",".join(["a b c", "1", "Tower"] + ["0"] * 70 + ["17"] + ["1"] * 1) + "\n")
    assert set(deal_files.HEADER_TOKENS) <= set(names)
    assert deal_files.read_deals(spark, str(tmp_path)).first()["floor"] == "17"
