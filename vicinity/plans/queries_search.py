"""Queries on exploring and searching sites, click statistics, snapshots and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import events, explore, quality, search, snapshots
from ..operators.grid import point_counts, with_cell
from . import tables as t
from .queries_scores import SCORE_CTES, metrics
from .registry import query
from .tables import SQL_CI, SQL_CJ, sql_metres, with_ctes

# --- Explore --------------------------------------------------------------------------------------
_WIDE = """SELECT s.site_id, s.name, s.gu, s.dong, s.lat, s.lng, s.households,
  CASE s.site_id % 3 WHEN 0 THEN ['1호선', '2호선'] WHEN 1 THEN ['공항철도1호선'] ELSE [] END AS subway_lines,
  CASE s.site_id % 4 WHEN 0 THEN ['종로3가역', '시청'] ELSE ['종로'] END AS station_names,
  CASE WHEN s.site_id % 5 > 0 THEN m.cafe END AS nightlife_count_500m, '학교' || (s.site_id % 10) AS assigned_elementary,
  s.site_id % 2 AS area_under_60, s.site_id % 3 AS area_60_85, CASE WHEN s.site_id % 4 > 0 THEN 0 END AS area_85_135, 0 AS area_over_135,
  s.site_id * 731 % 400000 AS trade_price, CASE WHEN s.site_id % 6 > 0 THEN s.site_id * 331 % 160000 END AS jeonse_price,
  m.hangang AS subway_distance, CASE WHEN s.site_id % 2 = 0 THEN m.hangang END AS emergency_distance,
  m.academy, m.hospital, m.bus, m.hangang FROM site s JOIN metric m USING (site_id)"""
_CTES = {"metric": SCORE_CTES["metric"], "wide": _WIDE}
_BASE = "site poi anchor"


def wide(spark, d):
    """One row per site with everything the conditions look at."""
    key = F.col("site_id")
    m = metrics(spark, d).select("site_id", "academy", "hospital", "bus", "cafe", "hangang")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    empty = F.array().cast("array<string>")
    type_of = F.when(key % 2 == 0, F.lit("간선")).otherwise(F.lit("지선"))
    return t.site(spark, d).join(m, "site_id").withColumns(
        {
            "subway_lines": F.when(key % 3 == 0, words("1호선", "2호선")).when(key % 3 == 1, words("공항철도1호선")).otherwise(empty),
            "station_names": F.when(key % 4 == 0, words("종로3가역", "시청")).otherwise(words("종로")),
            "nightlife_count_500m": F.when(key % 5 > 0, F.col("cafe")),
            "assigned_elementary": F.concat(F.lit("학교"), (key % 10).cast("string")),
            "area_under_60": key % 2, "area_60_85": key % 3, "area_85_135": F.when(key % 4 > 0, F.lit(0)), "area_over_135": F.lit(0),
            "trade_price": key * 731 % 400000, "jeonse_price": F.when(key % 6 > 0, key * 331 % 160000),
            "subway_distance": F.col("hangang"), "emergency_distance": F.when(key % 2 == 0, F.col("hangang")),
            "bus_routes": F.create_map(type_of, F.array((key % 7 + 140).cast("string"), F.lit("999"))),
        }
    )


_BONUS = "(coalesce(subway_distance <= 800, false)::INT + (emergency_distance IS NOT NULL)::INT)"


def _explore_sql(where: str, points: int = 0, label: str = "'생활 균형형'", order: str = "score DESC,", limit: int | None = 10, extra: str = "", bonus: bool = True):
    score = f"{points} + {_BONUS}" if bonus else str(points)
    cut = f"ORDER BY {order} gu, dong, name LIMIT {limit}" if limit else ""
    return f"SELECT site_id, {score} AS score, {label} AS labels FROM wide {extra} WHERE {where} {cut}"


def _explore(spark, d, filters, limit=10, priorities=(), schools=None):
    found = explore.explore(wide(spark, d), filters, limit=limit, priorities=priorities, schools=schools)
    return found.select("site_id", "score", F.array_join("labels", "|").alias("labels"))


@query("explore_default", with_ctes(_BASE, _explore_sql("true"), _CTES))
def explore_default(spark, d):
    return _explore(spark, d, {})


@query("explore_area", with_ctes(_BASE, _explore_sql("gu = 'NATION_4' AND dong = 'MACHINERY'", limit=None), _CTES))
def explore_area(spark, d):
    return _explore(spark, d, {"gu": "NATION_4", "dong": "MACHINERY"}, None)


@query("explore_line", with_ctes(_BASE, _explore_sql("list_contains(subway_lines, '1호선')", 3, "'1호선 접근'", limit=None), _CTES))
def explore_line(spark, d):
    return _explore(spark, d, {"line": "1호선"}, None)


@query("explore_station", with_ctes(_BASE, _explore_sql("site_id % 4 = 0", 3, "'종로3가역 접근'", limit=None), _CTES))
def explore_station(spark, d):
    return _explore(spark, d, {"station": "종로3가역"}, None)


@query(
    "explore_quiet_family",
    with_ctes(
        _BASE,
        _explore_sql(
            "nightlife_count_500m = 0 AND assigned_elementary = '학교3' AND greatest(coalesce(area_under_60, 0), coalesce(area_85_135, 0)) > 0",
            3, "'반경 500m이내 유흥시설 없음|학교3 배정'", limit=None,
        ),
        _CTES,
    ),
)
def explore_quiet_family(spark, d):
    filters = {"no_nightlife": "1", "assigned_elementary": "학교3", "area_buckets": ["u60", "85_135"]}
    return _explore(spark, d, filters, None)


@query(
    "explore_price_households",
    with_ctes(
        _BASE,
        _explore_sql("households >= 500 AND households < 1000 AND jeonse_price >= 50000 AND jeonse_price < 70000", 2, "'세대수 500_1000|전세 50000_70000'", limit=None),
        _CTES,
    ),
)
def explore_price_households(spark, d):
    return _explore(spark, d, {"household": "500_1000", "price_type": "jeonse", "price": "50000_70000"}, None)


@query(
    "explore_bus",
    with_ctes(_BASE, _explore_sql("site_id % 2 = 0 AND site_id % 7 = 3", 2, "'간선 143'", limit=None), _CTES),
)
def explore_bus(spark, d):
    return _explore(spark, d, {"bus_type": "간선", "bus_route": "143"}, None)


@query(
    "explore_school",
    with_ctes(
        _BASE,
        f"""SELECT site_id, 2 + {_BONUS} AS score, 'Supplier#000000007 ' || format('{{:,}}m', sd) AS labels FROM (
        SELECT wide.*, {sql_metres('wide', 'a')} AS sd FROM wide, anchor a WHERE a.name = 'Supplier#000000007') WHERE sd <= 1500""",
        _CTES,
    ),
)
def explore_school(spark, d):
    return _explore(spark, d, {"school": "Supplier#000000007"}, None, schools=t.anchor(spark, d))


@query(
    "explore_priorities",
    with_ctes(
        _BASE,
        """SELECT site_id, 0 AS score, CASE WHEN academy > 0 THEN '영어 ' || academy || '곳|' ELSE '' END || '응급실 ' || hospital || '곳|일반공원 ' || format('{:,}m', hangang) AS labels FROM wide
        WHERE hospital >= 1 AND hangang <= 1000 ORDER BY academy DESC, hospital DESC, hangang, gu, dong, name LIMIT 10""",
        _CTES,
    ),
)
def explore_priorities(spark, d):
    wishes = [
        explore.Priority("academy", "영어", "academy"), explore.Priority("medical", "응급실", "hospital", "hangang"),
        explore.Priority("park", "일반공원", "park_near", "hangang"),
    ]
    rows = wide(spark, d).withColumn("park_near", explore.presence("hangang", "일반공원"))
    found = explore.explore(rows, {}, priorities=wishes)
    return found.select("site_id", "score", F.array_join("labels", "|").alias("labels"))


@query(
    "explore_scenario",
    with_ctes(
        _BASE,
        "SELECT step, count(*) AS sites FROM wide, (VALUES (1), (2), (3)) v(step) WHERE gu = 'NATION_4' "
        "AND (step < 2 OR (households >= 500 AND households < 1000)) AND (step < 3 OR trade_price < 100000) GROUP BY 1",
        _CTES,
    ),
)
def explore_scenario(spark, d):
    """Three filter sets that grow step by step, and how many sites each leaves."""
    steps = explore.scenario_steps({"gu": "NATION_4"}, {"household": "500_1000"}, {"price_type": "trade", "price": "u100000"})
    rows = wide(spark, d)
    parts = [explore.explore(rows, f, limit=None).select(F.lit(k + 1).alias("step")) for k, f in enumerate(steps)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("step").agg(F.count("*").alias("sites"))


@query(
    "area_mix",
    with_ctes(
        _BASE,
        "SELECT site_id, n AS bucket_total, CAST(round_even(area_under_60 * 1000e0 / nullif(n, 0), 0) AS INT) AS area_under_60_permille, "
        "CAST(round_even(area_60_85 * 1000e0 / nullif(n, 0), 0) AS INT) AS area_60_85_permille, CAST(round_even(coalesce(area_85_135, 0) * 1000e0 / nullif(n, 0), 0) AS INT) AS area_85_135_permille, "
        "CAST(round_even(0e0 / nullif(n, 0), 0) AS INT) AS area_over_135_permille FROM (SELECT *, area_under_60 + area_60_85 AS n FROM wide)",
        _CTES,
    ),
)
def area_mix(spark, d):
    return explore.area_mix(wide(spark, d))


# --- Search and options ---------------------------------------------------------------------------
@query(
    "search_prefix",
    with_ctes("site", "SELECT site_id, false AS starts FROM site WHERE contains(lower(replace(name || ' ' || gu || ' ' || dong, ' ', '')), '0000001') ORDER BY site_id LIMIT 12"),
)
def search_prefix(spark, d):
    return search.search_sites(t.site(spark, d), "000 0001").select("site_id", "starts")


@query(
    "search_names",
    with_ctes("site", "SELECT site_id, starts_with(lower(name), 'customer#00000004') AS starts FROM site WHERE contains(lower(replace(name || ' ' || gu || ' ' || dong, ' ', '')), 'customer#00000004') ORDER BY starts DESC, site_id LIMIT 30"),
)
def search_names(spark, d):
    return search.search_sites(t.site(spark, d), "Customer#00000004", 100).select("site_id", "starts")


@query(
    "resolve_site",
    with_ctes("site", "SELECT site_id, name, gu, dong FROM site WHERE contains(name, '00004') ORDER BY name <> '00004', gu <> 'NATION_3', dong <> 'BUILDING', site_id LIMIT 1"),
)
def resolve_site(spark, d):
    found = search.resolve_site(t.site(spark, d), "00004", "NATION_3", "BUILDING")
    return found.select("site_id", "name", "gu", "dong")


def _rows(spark, d):
    return t.poi(spark, d).select("name", F.col("brand").alias("gu"), F.col("subtype").alias("dong"), F.col("poi_id").alias("ord"))


@query(
    "serving_table",
    with_ctes("poi", "SELECT name, brand AS gu, subtype AS dong, max(poi_id) AS ord FROM poi GROUP BY 1, 2, 3"),
)
def serving_table(spark, d):
    return search.serving_table(_rows(spark, d))


@query(
    "lookup_site",
    with_ctes(
        "poi",
        """SELECT 'key' AS how, max(poi_id) AS ord FROM poi WHERE name = 'red widget' AND brand = 'Brand#17' AND subtype = 'ECONOMY' HAVING count(*) > 0
        UNION ALL SELECT 'name', min(poi_id) FROM poi WHERE name = 'red widget' HAVING count(*) > 0""",
    ),
)
def lookup_site(spark, d):
    rows = _rows(spark, d)
    by_key = search.lookup_site(rows, "red widget", "Brand#17", "ECONOMY").select(F.lit("key").alias("how"), "ord")
    return by_key.unionByName(search.lookup_site(rows, "red widget").select(F.lit("name").alias("how"), "ord"))


@query(
    "options_distinct",
    with_ctes("poi", "SELECT value, starts_with(value, 'red') AS starts FROM (SELECT DISTINCT name AS value FROM poi WHERE contains(replace(name, ' ', ''), 'red')) ORDER BY starts DESC, value LIMIT 30"),
)
def options_distinct(spark, d):
    return search.options(t.poi(spark, d), "name", "red")


@query(
    "options_by_type",
    with_ctes("poi", "SELECT layer, name, CAST(row_number() OVER (PARTITION BY layer ORDER BY name) AS INT) AS place FROM (SELECT DISTINCT layer, name FROM poi)"),
)
def options_by_type(spark, d):
    return search.values_by_type(t.poi(spark, d), "layer", "name")


@query(
    "line_stations",
    with_ctes("poi", "SELECT DISTINCT brand AS line, name AS station FROM poi"),
)
def line_stations(spark, d):
    rows = t.poi(spark, d).select(F.concat("name", F.lit("역")).alias("name"), F.array("brand").alias("lines"))
    return search.line_stations(rows)


@query(
    "stations_of_line",
    with_ctes("poi", "SELECT DISTINCT name AS station FROM poi WHERE starts_with(brand, 'Brand#1') OR starts_with('Brand#1', brand) ORDER BY 1 LIMIT 30"),
)
def stations_of_line(spark, d):
    return search.stations_of_line(line_stations(spark, d), "Brand#1")


# --- Click statistics -----------------------------------------------------------------------------
_KINDS = {"view": "page_view", "click": "result_view", "purchase": "explore_search"}
_EVENT = {
    "ev": "SELECT *, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " ELSE event_type END AS kind FROM event"
}


def clicks(spark, d):
    """The event table under the click types; some combinations are the default one."""
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    rows = t.event(spark, d)
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.col("event_type"))
    return rows.withColumns({"event_type": kind, "combo_json": F.concat(F.lit("{"), "combo_key", F.lit("}"))})


@query(
    "event_kpi",
    with_ctes("event", "SELECT count(*) FILTER (kind = 'page_view') AS page_views, count(*) FILTER (kind = 'result_view') AS result_views, count(*) FILTER (kind = 'explore_search') AS explore_searches, count(DISTINCT visitor_hash) AS unique_visitors FROM ev", _EVENT),
)
def event_kpi(spark, d):
    return events.kpis(clicks(spark, d))


@query(
    "event_kpi_daily",
    with_ctes("event", "SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (kind = 'page_view') AS page_views, count(DISTINCT visitor_hash) AS unique_visitors, count(*) FILTER (kind IN ('result_view', 'explore_search')) AS searches FROM ev WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1", _EVENT),
)
def event_kpi_daily(spark, d):
    found = events.daily(events.between_days(clicks(spark, d), "2024-01-05", "2024-01-25"))
    return found.withColumn("day", F.col("day").cast("string"))


@query(
    "event_top_sites",
    with_ctes("event", "SELECT site_id, count(*) AS count, count(DISTINCT visitor_hash) AS visitors FROM ev WHERE kind = 'result_view' GROUP BY 1 ORDER BY count DESC, site_id LIMIT 20", _EVENT),
)
def event_top_sites(spark, d):
    return events.top_sites(clicks(spark, d))


@query(
    "event_top_combos",
    with_ctes("event", "SELECT combo_key, count(*) AS count, count(DISTINCT visitor_hash) AS visitors, max('{' || combo_key || '}') AS sample, round_even(avg(result_count) * 10, 0) / 10e0 AS avg_results FROM ev WHERE kind = 'explore_search' GROUP BY 1 ORDER BY count DESC, combo_key LIMIT 20", _EVENT),
)
def event_top_combos(spark, d):
    return events.top_filter_combos(clicks(spark, d))


@query(
    "event_weight_combos",
    with_ctes("event", "SELECT combo_key, count(*) AS count, count(DISTINCT visitor_hash) AS visitors, max('{' || combo_key || '}') AS sample FROM ev WHERE kind = 'result_view' GROUP BY 1 ORDER BY count DESC, combo_key LIMIT 20", _EVENT),
)
def event_weight_combos(spark, d):
    return events.top_weight_combos(clicks(spark, d))


@query(
    "event_sources",
    with_ctes("event", "SELECT src, count(*) AS count FROM ev WHERE kind = 'result_view' GROUP BY 1", _EVENT),
)
def event_sources(spark, d):
    return events.source_mix(clicks(spark, d))


@query(
    "event_search_sizes",
    with_ctes("event", "SELECT count(*) AS searches, round_even(avg(result_count) * 10, 0) / 10e0 AS avg_results, count(*) FILTER (result_count = 0) AS zero_results, round_even(count(*) FILTER (result_count = 0) * 100e0 / nullif(count(*), 0) * 10, 0) / 10e0 AS zero_result_pct FROM ev WHERE kind = 'explore_search'", _EVENT),
)
def event_search_sizes(spark, d):
    return events.search_sizes(clicks(spark, d))


# --- Snapshots ------------------------------------------------------------------------------------
_SNAP = {
    "a": f"SELECT layer, {SQL_CI} AS i, {SQL_CJ} AS j, CAST(count(*) AS DOUBLE) AS count FROM poi GROUP BY 1, 2, 3",
    "b": f"""SELECT layer, {SQL_CI} AS i, {SQL_CJ} AS j, CAST(count(*) AS DOUBLE) AS count FROM (
      SELECT layer, lat, lng FROM poi WHERE poi_id % 17 <> 0 UNION ALL SELECT layer, lat + 0.01e0, lng FROM poi WHERE poi_id % 19 = 0) GROUP BY 1, 2, 3""",
    "delta": """SELECT layer, i, j, coalesce(b.count, 0) - coalesce(a.count, 0) AS delta FROM a FULL JOIN b USING (layer, i, j)
      WHERE coalesce(b.count, 0) <> coalesce(a.count, 0)""",
}


def snapshot_pair(spark, d):
    """Located pois before and after: some are gone, some have a shifted copy."""
    poi = t.poi(spark, d)
    moved = poi.where("poi_id % 19 = 0").withColumn("lat", F.col("lat") + 0.01)
    after = poi.where("poi_id % 17 <> 0").unionByName(moved)
    return tuple(snapshots.snapshot_cells(point_counts(p)) for p in (poi, after))


@query("snapshot_diff", with_ctes("poi", "SELECT * FROM delta", _SNAP))
def snapshot_diff(spark, d):
    return snapshots.snapshot_diff(*snapshot_pair(spark, d))


@query(
    "snapshot_layers",
    with_ctes("poi", "SELECT layer, count(*) AS located_cells, sum(count) AS total_count FROM b GROUP BY 1", _SNAP),
)
def snapshot_layers(spark, d):
    return snapshots.snapshot_layers(snapshot_pair(spark, d)[1])


@query(
    "snapshot_changes",
    with_ctes(
        "poi",
        "SELECT layer, c.cells, c.delta, x.before, x.after FROM (SELECT layer, count(*) AS cells, sum(delta) AS delta FROM delta GROUP BY 1) c "
        "JOIN (SELECT layer, sum(count) AS before FROM a GROUP BY 1) USING (layer) JOIN (SELECT layer, sum(count) AS after FROM b GROUP BY 1) USING (layer)"
        .replace("x.before, x.after", "before, after"),
        _SNAP,
    ),
)
def snapshot_changes(spark, d):
    before, after = snapshot_pair(spark, d)
    totals = snapshots.layer_totals_change(before, after).drop("delta")
    return snapshots.layer_changes(snapshots.snapshot_diff(before, after)).join(totals, "layer")


@query(
    "snapshot_biggest",
    with_ctes(
        "site poi",
        f"""SELECT layer, i, j, delta, coalesce(gu, '?') AS gu, coalesce(dong, '?') AS dong FROM (SELECT * FROM delta ORDER BY abs(delta) DESC, layer, i, j LIMIT 10)
        LEFT JOIN (SELECT {SQL_CI} AS i, {SQL_CJ} AS j, min(gu) AS gu, min(dong) AS dong FROM site GROUP BY 1, 2) USING (i, j)""",
        _SNAP,
    ),
)
def snapshot_biggest(spark, d):
    zone = with_cell(t.site(spark, d)).groupBy("i", "j").agg(F.min("gu").alias("gu"), F.min("dong").alias("dong"))
    return snapshots.biggest_changes(snapshots.snapshot_diff(*snapshot_pair(spark, d)), zone)


@query(
    "source_status",
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 6 THEN 'error' WHEN c_custkey % 5 = 4 THEN 'checked_no_remote_date' WHEN c_custkey % 3 = 0 THEN 'first_check'
    WHEN c_custkey % 2 = 0 THEN 'update_available' ELSE 'up_to_date' END AS state FROM customer""",
)
def source_status(spark, d):
    from ..sources.freshness import source_status as compare

    rows = t.read(spark, d, "customer")
    current = rows.selectExpr(
        "c_custkey AS key", "CASE WHEN c_custkey % 7 = 6 THEN 'error' ELSE 'ok' END AS status",
        "CASE WHEN c_custkey % 5 <> 4 THEN concat('2024-01-0', c_custkey % 2) END AS updated_at",
    )
    previous = rows.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS key", "'2024-01-01' AS updated_at")
    return compare(current, previous).select("key", "state")


_MEDICAL, _CULTURE, _PARK = (explore.PRIORITY_SUBTYPES[k] for k in ("medical", "culture", "park"))


@query(
    "derived_stats",
    f"""SELECT c_custkey AS site_id, c_custkey % 4 AS "medical_{_MEDICAL[0]}_count", CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 900)::DOUBLE END AS "medical_{_MEDICAL[0]}_nearest",
    c_custkey % 3 AS "medical_{_MEDICAL[1]}_count", CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 4000)::DOUBLE END AS "medical_{_MEDICAL[1]}_nearest",
    CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE (c_custkey % 700 <= 500)::BIGINT END AS "medical_{_MEDICAL[2]}_count", CASE WHEN c_custkey % 700 <= 500 THEN (c_custkey % 700)::DOUBLE END AS "medical_{_MEDICAL[2]}_nearest",
    (c_custkey % 600 <= 500)::BIGINT + (c_custkey % 600 + 50 <= 500)::BIGINT AS "medical_{_MEDICAL[3]}_count", CASE WHEN c_custkey % 600 <= 500 THEN (c_custkey % 600)::DOUBLE END AS "medical_{_MEDICAL[3]}_nearest",
    """
    + ", ".join(f"c_custkey % {k + 2} AS \"culture_{x}_count\", (c_custkey % 1500)::DOUBLE AS \"culture_{x}_nearest\"" for k, x in enumerate(_CULTURE))
    + ", "
    + ", ".join(
        f"(c_custkey % {m} <= {explore.PARK_PRESENCE_M[x]})::BIGINT AS \"park_{x}_count\", (c_custkey % {m})::DOUBLE AS \"park_{x}_nearest\"" for m, x in zip((1400, 3500, 3200), _PARK)
    )
    + " FROM customer",
)
def derived_stats(spark, d):
    """Counts and nearest distances behind the wishes for medicine, culture and parks."""
    key = F.col("c_custkey")
    item = lambda name, metres: F.struct(F.lit(name).alias("subtype"), metres.cast("double").alias("distance"))
    items = F.array(item(f" {_MEDICAL[2]}", key % 700), item(_MEDICAL[3], key % 600 + 50), item(_MEDICAL[3], key % 600))
    table = t.read(spark, d, "customer").select(
        key.alias("site_id"), (key % 4).alias("emergency_count_1km"), F.when(key % 4 > 0, key % 900).alias("nearest_emergency_distance"),
        (key % 3).alias("superior_hospital_count_5km"), F.when(key % 3 > 0, key % 4000).alias("nearest_superior_hospital_distance"),
        items.alias("medical_items"), F.when(key % 5 == 0, 7).alias(f"{_MEDICAL[2]}_count_500m"), (key % 1500).alias("nearest_culture_distance"),
        *((key % (k + 2)).alias(c) for k, c in enumerate(explore.CULTURE_COLUMNS.values())),
        (key % 1400).alias("park_distance"), (key % 3500).alias("hangang_distance"), (key % 3200).alias("big_park_distance"),
    )
    return explore.medical_stats(table).join(explore.culture_stats(table), "site_id").join(explore.park_stats(table), "site_id")


# --- Data quality ---------------------------------------------------------------------------------
@query(
    "dq_report",
    with_ctes(
        "site poi anchor",
        """SELECT 'metrics' AS "table", "check", CASE WHEN n = 0 THEN 'OK' ELSE lvl END AS level, n FROM (
        SELECT 'required_columns' AS "check", 'ERROR' AS lvl, 1 AS n UNION ALL SELECT 'coordinates_numeric', 'ERROR', 0
        UNION ALL SELECT 'coordinates_in_bounds', 'WARN', count(*) FILTER (NOT (lat BETWEEN 37.4e0 AND 37.5e0 AND lng BETWEEN 126.76e0 AND 127.19e0)) FROM site
        UNION ALL SELECT 'json_parse:note', 'ERROR', count(*) FILTER (site_id % 10 = 3) FROM site UNION ALL SELECT 'json_empty:note', 'WARN', count(*) FILTER (site_id % 10 = 4) FROM site
        UNION ALL SELECT 'negative_counts', 'ERROR', count(*) FILTER (site_id % 4 = 0) FROM site UNION ALL SELECT 'negative_distances', 'ERROR', 0
        UNION ALL SELECT 'radius_order:a_count_300m<=a_count_500m', 'WARN', count(*) FILTER (site_id % 4 <> 0 AND 2 > site_id % 3) FROM site
        UNION ALL SELECT 'percent_range:pct', 'ERROR', count(*) FILTER (site_id % 6 <> 0 AND site_id % 120 > 100) FROM site UNION ALL SELECT 'percent_empty:pct', 'WARN', count(*) FILTER (site_id % 6 = 0) FROM site
        UNION ALL SELECT 'primary_metric_invalid', 'ERROR', 0 UNION ALL SELECT 'primary_metric_empty', 'WARN', count(*) FILTER (site_id % 6 = 0) FROM site
        UNION ALL SELECT 'row_count', 'WARN', greatest((SELECT count(*) FROM poi) - count(*), 0) FROM site UNION ALL SELECT 'rows_present', 'ERROR', 0
        UNION ALL SELECT 'duplicate_names', 'WARN', count(*) FROM (SELECT gu FROM site GROUP BY 1 HAVING count(*) > 1))""",
    ),
)
def dq_report(spark, d):
    """The checks over the sites, with defects planted by key."""
    sites = t.site(spark, d)
    rows = sites.selectExpr(
        "gu AS name", "lat", "lng", "CASE WHEN site_id % 10 = 3 THEN '{broken' WHEN site_id % 10 = 4 THEN '' ELSE '[]' END AS note",
        "CASE WHEN site_id % 4 = 0 THEN -1 ELSE 2 END AS a_count_300m", "site_id % 3 AS a_count_500m", "100 AS near_distance",
        "CASE WHEN site_id % 6 <> 0 THEN cast(site_id % 120 AS double) END AS pct",
    )
    spec = quality.TableSpec(
        "metrics", required=["name", "gu", "lat", "lng"], primary_metric="pct", json_columns=["note"],
        radius_rules=[("a_count_300m", "a_count_500m")], percent_columns=["pct"], expected_rows=quality.expected_rows([sites, t.poi(spark, d)]),
        bounds=(37.4, 37.5, 126.76, 127.19),
    )
    return quality.dq_checks(rows, spec)


@query(
    "dq_master_coverage",
    """SELECT 'parks' AS "table", "check", CASE WHEN n = 0 THEN 'OK' ELSE 'WARN' END AS level, n FROM (
    SELECT 'missing_in_master' AS "check", count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0)
    UNION ALL SELECT 'missing_in_source', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0 EXCEPT SELECT o_custkey FROM orders))""",
)
def dq_master_coverage(spark, d):
    source = t.read(spark, d, "orders").select(F.col("o_custkey").alias("park"))
    master = t.read(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("park"))
    return quality.coverage_checks(source, master, "park", "parks")


@query(
    "geocode_fill",
    "SELECT c_custkey AS site_id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 1e0 WHEN c_custkey % 4 <> 0 THEN 2e0 END AS lat, c_custkey % 4 = 0 AND c_custkey % 3 = 0 AS filled FROM customer",
)
def geocode_fill(spark, d):
    """Blank coordinates take the approved override; others stay."""
    from ..sources.geocodes import fill_blank_coordinates

    key = F.col("c_custkey")
    rows = t.read(spark, d, "customer").select(
        key.alias("site_id"), F.col("c_name").alias("name"), F.lit("g").alias("gu"), F.lit("d").alias("dong"),
        F.when(key % 4 != 0, 2.0).alias("lat"), F.when(key % 4 != 0, 3.0).alias("lng"),
    )
    approved = rows.where("site_id % 3 = 0").select("name", "gu", "dong", F.lit(1.0).alias("lat"), F.lit(5.0).alias("lng"))
    return fill_blank_coordinates(rows, approved).select("site_id", "lat", "filled")


@query(
    "geocode_pending",
    "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def geocode_pending(spark, d):
    """Rows that no earlier run has settled."""
    from ..sources.geocodes import pending

    done = t.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"))
    return pending(t.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), done, "id")


@query(
    "item_lists",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE least(c_custkey % 50, 25) END AS nearest FROM customer""",
)
def item_lists(spark, d):
    """JSON item lists parsed and ordered by distance; broken text gives an empty list."""
    from ..sources.items import parse_items

    key = F.col("c_custkey")
    text = F.format_string('[{"label": "a", "distance": 25}, {"label": "b", "distance": %d}]', key % 50)
    rows = t.read(spark, d, "customer").select("c_custkey", F.when(key % 9 == 0, "[{broken").otherwise(text).alias("j"))
    found = rows.select("c_custkey", parse_items("j").alias("i"))
    return found.select(
        "c_custkey", F.size("i").cast("int").alias("n"), F.get("i", F.lit(0))["distance"].cast("long").alias("nearest")
    )


@query(
    "detail_shards",
    with_ctes("site", "SELECT site_id, name, substr(sha1(name), 1, 16) AS shard FROM site"),
)
def detail_shards(spark, d):
    from ..sources.sinks import shard_of

    return t.site(spark, d).select("site_id", "name", shard_of("name").alias("shard"))
