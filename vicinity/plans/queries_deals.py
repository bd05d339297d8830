"""Queries on deals: normalising, summaries, tabs, and matching records to sites."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import GENERIC_NAMES
from ..operators import deals, matching, search
from ..session import once, spread
from . import sql_matching, tables as t
from .registry import query
from .tables import with_ctes

AS_OF = datetime.date.fromisoformat(t.AS_OF)
_DAY = f"DATE '{t.AS_OF}'"


# --- Raw records ----------------------------------------------------------------------------------
def raw_deals(spark, d):
    """Text records as the ministry files have them, from line items, orders and customers."""
    orders = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    names = t.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    rows = t.read(spark, d, "lineitem").join(orders, "l_orderkey").join(names, "o_custkey")
    trade = F.col("l_returnflag") == "R"
    text = lambda c: F.col(c).cast("string")
    amount = F.format_number("l_extendedprice", 0)
    return rows.select(
        F.concat_ws(" ", F.lit("서울특별시"), F.concat(F.lit("구"), text("c_nationkey")), "c_mktsegment").alias("region"),
        F.concat(F.col("c_name"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(" apt")).otherwise(F.lit("(주상복합)"))).alias("apartment_name"),
        F.concat(F.lit("길 "), (F.col("o_custkey") % 97).cast("string")).alias("road_name"),
        F.lit("").alias("lot"), F.lpad((F.col("o_custkey") % 89).cast("string"), 4, "0").alias("bonbun"),
        F.lpad((F.col("o_custkey") % 3).cast("string"), 4, "0").alias("bubun"),
        F.date_format("l_shipdate", "yyyyMM").alias("year_month"), F.date_format("l_shipdate", "d").alias("day"),
        text("l_quantity").alias("area"), F.when(trade, amount).alias("price"), F.when(~trade, amount).alias("deposit"),
        F.when(F.col("l_returnflag") == "N", (F.col("l_partkey") % 90).cast("string")).alias("monthly"),
        text("l_linenumber").alias("floor"), F.lit("1999").alias("built"),
        F.when(F.col("l_suppkey") % 10 == 9, "오피스텔").otherwise("아파트").alias("housing_type"),
        F.when(trade, "trade").otherwise("rent").alias("transaction_type"), F.lit("deals_2001.csv").alias("source_file"),
    )


_RAW = """SELECT l.*, o_custkey, c_name, '구' || c_nationkey AS gu, c_mktsegment AS dong, c_nationkey FROM lineitem l
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"""
_NORMALISED = """SELECT CASE WHEN l_returnflag = 'R' THEN 'trade' ELSE 'rent' END AS transaction_type,
  CASE WHEN l_returnflag = 'R' THEN '매매' WHEN l_returnflag = 'N' AND l_partkey % 90 > 0 THEN '월세' ELSE '전세' END AS deal_type,
  gu, dong, (o_custkey % 89)::VARCHAR AS bonbun, nullif((o_custkey % 3)::VARCHAR, '0') AS bubun, '길 ' || (o_custkey % 97) AS road_name,
  c_name || CASE WHEN l_suppkey % 2 = 0 THEN ' apt' ELSE '(주상복합)' END AS apartment_name,
  lower(replace(c_name, '#', '')) AS normalized_apartment_name, '서울특별시 ' || gu || ' 길 ' || (o_custkey % 97) AS road_address,
  strftime(l_shipdate, '%Y-%m-%d') AS deal_date, l_quantity AS area_m2, CAST(l_linenumber AS BIGINT) AS floor,
  CASE WHEN l_returnflag = 'R' THEN CAST(round_even(l_extendedprice, 0) AS BIGINT) END AS deal_amount,
  CASE WHEN l_returnflag <> 'R' THEN CAST(round_even(l_extendedprice, 0) AS BIGINT) END AS deposit_amount,
  CASE l_returnflag WHEN 'N' THEN l_partkey % 90 WHEN 'A' THEN 0 END AS monthly_rent FROM raw
  WHERE l_suppkey % 10 <> 9 AND year(l_shipdate) >= 1997"""
_DEAL_COLUMNS = [
    "transaction_type", "deal_type", "gu", "dong", "bonbun", "bubun", "road_name", "apartment_name", "normalized_apartment_name",
    "road_address", "deal_date", "area_m2", "floor", "deal_amount", "deposit_amount", "monthly_rent",
]


def master(spark, d):
    return deals.normalise(raw_deals(spark, d), 1997)


@query("deal_normalise", with_ctes("", _NORMALISED, {"raw": _RAW}))
def deal_normalise(spark, d):
    rows = master(spark, d).select(*_DEAL_COLUMNS)
    return rows.withColumn("deal_date", F.col("deal_date").cast("string"))


@query(
    "deal_dedupe",
    with_ctes(
        "",
        "SELECT gu, dong, count(*) AS deals, CAST(sum(coalesce(deal_amount, deposit_amount)) AS BIGINT) AS total FROM (SELECT DISTINCT "
        + ", ".join(deals.DEAL_KEY) + " FROM norm) GROUP BY 1, 2",
        {"raw": _RAW, "norm": _NORMALISED},
    ),
)
def deal_dedupe(spark, d):
    once = deals.dedupe(master(spark, d))
    return once.groupBy("gu", "dong").agg(
        F.count("*").alias("deals"), F.sum(F.coalesce("deal_amount", "deposit_amount")).alias("total")
    )


@query(
    "store_dedupe",
    with_ctes(
        "camera",
        "SELECT min(poi_id) AS poi_id FROM camera GROUP BY round_even(lat * 100000, 0), round_even(lng * 100000, 0)",
    ),
)
def store_dedupe(spark, d):
    return deals.dedupe_stores(t.camera(spark, d)).select("poi_id")


# --- Summaries ------------------------------------------------------------------------------------
def _count(kind, days):
    return f"count(*) FILTER ({kind} AND deal_date >= {_DAY} - {days})"


_T, _R = "transaction_type = 'trade'", "transaction_type = 'rent'"
_J, _M = f"{_R} AND coalesce(monthly_rent, 0) = 0", f"{_R} AND monthly_rent > 0"
_LAST = "ORDER BY deal_date DESC, deal_key DESC, {v} DESC, area_m2 DESC, floor DESC"


def _avg(value, test):
    return f"round_even(avg({value}) FILTER ({test}) * 10, 0) / 10e0"


_SUMMARY = f"""SELECT s.site_id, {_count(_T, 93)} AS trade_count_3m, {_count(_T, 365)} AS trade_count_1y, {_count(_R, 93)} AS rent_count_3m,
  {_count(_R, 365)} AS rent_count_1y, {_count(_J, 93)} AS jeonse_count_3m, {_count(_J, 365)} AS jeonse_count_1y,
  {_count(_M, 93)} AS monthly_count_3m, {_count(_M, 365)} AS monthly_count_1y,
  {_avg('deal_amount', _T + f' AND deal_date >= {_DAY} - 365')} AS avg_trade_amount_1y,
  {_avg('deposit_amount', _J + f' AND deal_date >= {_DAY} - 365')} AS avg_rent_deposit_1y,
  {_avg('deal_amount', _T + ' AND area_m2 BETWEEN 80 AND 90')} AS avg_trade_amount_84,
  {_avg('deposit_amount', _J + ' AND area_m2 BETWEEN 80 AND 90')} AS avg_rent_amount_84,
  max(deal_amount) FILTER ({_T} AND deal_date >= {_DAY} - 365) AS max_trade_amount_1y,
  min(deal_amount) FILTER ({_T} AND deal_date >= {_DAY} - 365) AS min_trade_amount_1y,
  first(deal_amount {_LAST.format(v='deal_amount')}) FILTER ({_T}) AS latest_trade_amount,
  first(area_m2 {_LAST.format(v='deal_amount')}) FILTER ({_T}) AS lt_area,
  first(deal_date {_LAST.format(v='deal_amount')}) FILTER ({_T}) AS lt_date,
  first(deposit_amount {_LAST.format(v='deposit_amount')}) FILTER ({_J}) AS latest_rent_deposit,
  first(deal_date {_LAST.format(v='deposit_amount')}) FILTER ({_J}) AS lr_date,
  count(deal_amount) FILTER ({_T} AND deal_date >= {_DAY} - 183) AS rn, avg(deal_amount) FILTER ({_T} AND deal_date >= {_DAY} - 183) AS ra,
  count(deal_amount) FILTER ({_T} AND deal_date >= {_DAY} - 365 AND deal_date < {_DAY} - 183) AS pn,
  avg(deal_amount) FILTER ({_T} AND deal_date >= {_DAY} - 365 AND deal_date < {_DAY} - 183) AS pa
  FROM site s LEFT JOIN deal USING (site_id) GROUP BY 1"""
_TREND = "CASE WHEN rn < 2 OR pn < 2 THEN 'insufficient' WHEN ra >= pa * 1.03e0 THEN 'up' WHEN ra <= pa * 0.97e0 THEN 'down' ELSE 'flat' END"


@query(
    "deal_summary",
    with_ctes(
        "site deal",
        f"""SELECT * EXCLUDE (lt_area, lt_date, lr_date, rn, ra, pn, pa), CAST(lt_date AS VARCHAR) AS latest_trade_date, CAST(lr_date AS VARCHAR) AS latest_rent_date,
        round_even(latest_rent_deposit / latest_trade_amount * 100 * 10, 0) / 10e0 AS jeonse_ratio, {_TREND} AS recent_trade_trend,
        round_even(latest_trade_amount / lt_area * 10, 0) / 10e0 AS price_per_m2 FROM summary""",
        {"summary": _SUMMARY},
    ),
)
def deal_summary(spark, d):
    found = deals.deal_summary(t.site(spark, d), t.deal(spark, d), AS_OF)
    return found.withColumns(
        {c: F.col(c).cast("string") for c in ("latest_trade_date", "latest_rent_date")}
    )


@query(
    "deal_trend",
    with_ctes("site deal", f"SELECT trend, count(*) AS sites FROM (SELECT {_TREND} AS trend FROM summary) GROUP BY 1", {"summary": _SUMMARY}),
)
def deal_trend(spark, d):
    found = deals.deal_summary(t.site(spark, d), t.deal(spark, d), AS_OF)
    return found.groupBy(F.col("recent_trade_trend").alias("trend")).agg(F.count("*").alias("sites"))


@query(
    "latest_deal",
    with_ctes(
        "deal",
        """SELECT site_id, deal_amount, CAST(deal_date AS VARCHAR) AS deal_date, area_m2, floor FROM deal WHERE deal_amount IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY deal_date DESC, deal_key DESC, deal_amount DESC, area_m2 DESC, floor DESC) = 1""",
    ),
)
def latest_deal(spark, d):
    return deals.latest_deals(t.deal(spark, d)).withColumn("deal_date", F.col("deal_date").cast("string"))


_LABEL = "CAST(round_even(area_m2, 0) AS INT) || '㎡'"
_COUNTS = f"""SELECT site_id, {_LABEL} AS area_label, count(*) AS count, count(*) FILTER (filter_type = 'sale') AS sale_count,
  count(*) FILTER (filter_type = 'jeonse') AS jeonse_count, count(*) FILTER (filter_type = 'monthly') AS monthly_count,
  first(deal_amount {_LAST.format(v='deal_amount')}) FILTER ({_T}) AS latest_sale, first(deposit_amount {_LAST.format(v='deposit_amount')}) FILTER ({_R}) AS latest_rent
  FROM deal GROUP BY 1, 2"""
_TABS = """SELECT * EXCLUDE (most), (count >= 5 AND count / most >= 0.03e0 AND place <= 5) OR place = 1 AS is_primary FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY count DESC, CAST(regexp_replace(area_label, '[^0-9]', '', 'g') AS INT), area_label) AS INT) AS place,
  max(count) OVER (PARTITION BY site_id) AS most FROM counts)"""


@query("area_tabs", with_ctes("deal", _TABS, {"counts": _COUNTS}))
def area_tabs(spark, d):
    return deals.area_tabs(deals.area_counts(t.deal(spark, d)))


@query(
    "representative_area",
    with_ctes(
        "deal",
        """SELECT site_id, area_label, latest_sale, sale_count FROM tabs WHERE sale_count > 0
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sale_count DESC, place) = 1""",
        {"counts": _COUNTS, "tabs": _TABS},
    ),
)
def representative_area(spark, d):
    return deals.representative_area(deals.area_tabs(deals.area_counts(t.deal(spark, d))))


_CAPPED = f"""SELECT *, row_number() OVER (PARTITION BY site_id, {_LABEL}, filter_type ORDER BY deal_date DESC, deal_key DESC,
  coalesce(deal_amount, deposit_amount) DESC, area_m2 DESC, floor DESC, monthly_rent DESC) AS rank, {_LABEL} AS area_label FROM deal"""


@query(
    "deal_cap",
    with_ctes(
        "deal",
        "SELECT site_id, area_label, filter_type, CAST(rank AS INT) AS rank, coalesce(deal_amount, deposit_amount) AS amount, "
        f"CAST(deal_date AS VARCHAR) AS deal_date FROM ({_CAPPED}) WHERE rank <= 2",
    ),
)
def deal_cap(spark, d):
    """The cap at two, so that it cuts on this data."""
    kept = deals.capped_deals(t.deal(spark, d), 2)
    return kept.select(
        "site_id", "area_label", "filter_type", "rank", F.coalesce("deal_amount", "deposit_amount").alias("amount"),
        F.col("deal_date").cast("string").alias("deal_date"),
    )


@query(
    "deal_details",
    with_ctes(
        "deal",
        f"""SELECT site_id, count(*) AS tabs, count(*) FILTER (is_primary) AS primary_tabs, any_value(n) AS rows, first(area_label ORDER BY place) AS first_label,
        first(format('{{:,}}', sale_count) || '/' || format('{{:,}}', jeonse_count) || '/' || format('{{:,}}', monthly_count) ORDER BY place) AS first_counts,
        'dong' || (site_id % 7) || ' apt' || site_id AS named FROM tabs JOIN (SELECT site_id, count(*) AS n FROM ({_CAPPED}) WHERE rank <= 80 GROUP BY 1) USING (site_id) GROUP BY 1""",
        {"counts": _COUNTS, "tabs": _TABS},
    ),
)
def deal_details(spark, d):
    """The JSON payloads, read back and counted."""
    schema = (
        "struct<area_tabs: array<struct<area_label: string, is_primary: boolean, sale_count_label: string, jeonse_count_label: string, monthly_count_label: string>>, "
        "transactions_by_area: map<string, array<struct<price: string, date: string, dong: string, apt_name: string>>>>"
    )
    named = {"dong": F.concat(F.lit("dong"), (F.col("site_id") % 7).cast("string")), "apartment_name": F.concat(F.lit("apt"), F.col("site_id").cast("string"))}
    parsed = deals.detail_payloads(t.deal(spark, d).withColumns(named)).select("site_id", F.from_json("payload", schema).alias("p"))
    rows = F.aggregate(F.map_values("p.transactions_by_area"), F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    return parsed.select(
        "site_id", F.size("p.area_tabs").cast("long").alias("tabs"),
        F.size(F.filter("p.area_tabs", lambda x: x["is_primary"])).cast("long").alias("primary_tabs"),
        rows.alias("rows"), F.get("p.area_tabs", F.lit(0))["area_label"].alias("first_label"),
        F.concat_ws("/", *(F.get("p.area_tabs", F.lit(0))[f"{k}_count_label"] for k in ("sale", "jeonse", "monthly"))).alias("first_counts"),
        F.array_join(F.array_distinct(F.transform(F.flatten(F.map_values("p.transactions_by_area")), lambda x: F.concat_ws(" ", x["dong"], x["apt_name"]))), "|").alias("named"),
    )


@query(
    "area_prices",
    with_ctes(
        "deal",
        f"""SELECT site_id, {_LABEL} AS area_label, filter_type, count(*) AS count, CAST(round_even(avg(v), 0) AS BIGINT) AS average,
        first(v ORDER BY deal_date DESC, deal_key DESC, v DESC) AS latest FROM (SELECT *, coalesce(deal_amount, deposit_amount) AS v FROM deal WHERE filter_type <> 'monthly') GROUP BY 1, 2, 3""",
    ),
)
def area_prices(spark, d):
    return deals.area_prices(t.deal(spark, d)).drop("average_text", "range_text")


@query(
    "deal_badges",
    with_ctes(
        "site deal",
        """SELECT s.site_id, CASE WHEN n = 0 THEN '데이터 부족' WHEN len(b) = 0 THEN '최근 거래 있음' ELSE array_to_string(b[1:4], '|') END AS badges FROM (
        SELECT site_id, trade_count_1y + rent_count_1y AS n, list_filter([
        CASE WHEN trade_count_1y + rent_count_1y >= 100 THEN '거래 활발' WHEN trade_count_1y + rent_count_1y >= 10 THEN '최근 거래 있음' END,
        CASE WHEN rent_count_1y >= 10 AND rent_count_1y > trade_count_1y * 3 THEN '전월세 수요 높음' END,
        CASE WHEN m > 0 THEN '월세 거래 있음' END, CASE WHEN a <= 60 THEN '소형 거래 중심' WHEN a >= 84 THEN '중대형 거래 있음' END], lambda x: x IS NOT NULL) AS b
        FROM summary LEFT JOIN (SELECT site_id, sum(monthly_count) AS m, CAST(regexp_replace(first(area_label ORDER BY place), '[^0-9]', '', 'g') AS INT) AS a
        FROM tabs GROUP BY 1) USING (site_id)) s""",
        {"summary": _SUMMARY, "counts": _COUNTS, "tabs": _TABS},
    ),
)
def deal_badges(spark, d):
    rows = t.deal(spark, d)
    summary = deals.deal_summary(t.site(spark, d), rows, AS_OF)
    tabs = deals.area_tabs(deals.area_counts(rows))
    return deals.insight_badges(summary, tabs).select("site_id", F.array_join("badges", "|").alias("badges"))


# --- Matching -------------------------------------------------------------------------------------
def match_sites_table(spark, d):
    """Sites with addresses: a third has a road address, the rest a road number, a lot, or a name only."""
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    lone = (key % 13 == 5) & (key % 3 == 1)
    lot = F.when(key % 9 == 8, text(key % 1500 + 100)).when(key % 3 == 2, text(key % 40 + 1))
    return t.read(spark, d, "customer").select(
        key.alias("site_id"),
        F.when(lone, F.concat(F.lit("무명"), text(key)))
        .otherwise(F.concat(F.lit("단지"), text(key % 400), F.lit("마을 "), text(F.floor(key / 400)))).alias("name"),
        F.concat(F.lit("구"), text(key % 5)).alias("gu"), F.concat(F.lit("동"), text(key % 7)).alias("dong"),
        F.when(key % 3 == 0, F.concat(F.lit("서울특별시 구"), text(key % 5), F.lit(" 길"), text(key % 300))).alias("road_address"),
        F.when((key % 6 == 1) & ~lone, F.concat(F.lit("길"), text(key % 60))).alias("road_name"),
        F.when(key % 6 == 1, text(key % 50 + 1)).alias("road_detail"),
        lot.alias("bonbun"), F.when(key % 4 == 3, text(key % 2)).alias("bubun"), lot.alias("jibun"), (key % 11 == 0).alias("is_rental"),
    )


def match_deals_table(spark, d):
    """Deal records whose names vary by order: as registered, shortened, or with a suffix."""
    key, o = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    stem = F.concat(F.lit("단지"), text(key % 400), F.lit("마을"))
    return t.read(spark, d, "orders").select(
        F.when(o % 4 == 0, F.concat(stem, text(F.floor(key / 400)), F.lit("아파트")))
        .when(o % 4 == 1, stem).when(o % 4 == 2, F.concat(F.lit("신"), stem, text(F.floor(key / 400)))).otherwise(F.concat(F.lit("동"), text(key % 7), stem)).alias("apartment_name"),
        F.concat(F.lit("구"), text(key % 5)).alias("gu"), F.concat(F.lit("동"), text(key % 7)).alias("dong"),
        F.concat(F.lit("길"), text(key % 60)).alias("road_name"),
        F.when((o % 3 == 0) & (o % 4 != 2), F.concat(F.lit("서울특별시 구"), text(key % 5), F.lit(" 길"), text(key % 300))).alias("road_address"),
        F.when(o % 4 == 2, text(key % 1500 + 100)).otherwise(text(key % 40 + 1)).alias("bonbun"), F.when(key % 4 == 3, text(key % 2)).alias("bubun"),
        F.when(o % 2 == 0, "trade").otherwise("rent").alias("transaction_type"),
    )


_SITE_SQL = """SELECT c_custkey AS site_id, CASE WHEN c_custkey % 13 = 5 AND c_custkey % 3 = 1 THEN '무명' || c_custkey ELSE '단지' || (c_custkey % 400) || '마을' || (c_custkey // 400) END AS name_norm, '구' || (c_custkey % 5) AS gu, '동' || (c_custkey % 7) AS dong_norm,
  CASE WHEN c_custkey % 3 = 0 THEN '구' || (c_custkey % 5) || '길' || (c_custkey % 300) ELSE '' END AS road_norm,
  CASE WHEN c_custkey % 6 = 1 AND c_custkey % 13 <> 5 THEN '길' || (c_custkey % 60) ELSE '' END AS road_name_norm, CASE WHEN c_custkey % 6 = 1 THEN (c_custkey % 50 + 1)::VARCHAR ELSE '' END AS detail_norm,
  CASE WHEN c_custkey % 9 = 8 THEN (c_custkey % 1500 + 100)::VARCHAR WHEN c_custkey % 3 = 2 THEN (c_custkey % 40 + 1)::VARCHAR END AS bonbun, CASE WHEN c_custkey % 4 = 3 THEN (c_custkey % 2)::VARCHAR ELSE '' END AS bubun, c_custkey % 11 = 0 AS is_rental FROM customer"""
_DEAL_SQL = """SELECT CASE o_orderkey % 4 WHEN 0 THEN stem || (o_custkey // 400) || '아파트' WHEN 1 THEN stem WHEN 2 THEN '신' || stem || (o_custkey // 400) ELSE '동' || (o_custkey % 7) || stem END AS apartment_name,
  CASE o_orderkey % 4 WHEN 0 THEN stem || (o_custkey // 400) WHEN 1 THEN stem WHEN 2 THEN '신' || stem || (o_custkey // 400) ELSE '동' || (o_custkey % 7) || stem END AS cand_norm,
  '구' || (o_custkey % 5) AS gu, '동' || (o_custkey % 7) AS dong_norm, '길' || (o_custkey % 60) AS road_name,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 2 THEN '서울특별시 구' || (o_custkey % 5) || ' 길' || (o_custkey % 300) END AS road_address,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 2 THEN '구' || (o_custkey % 5) || '길' || (o_custkey % 300) ELSE '' END AS road_norm,
  CASE WHEN o_orderkey % 4 = 2 THEN (o_custkey % 1500 + 100)::VARCHAR ELSE (o_custkey % 40 + 1)::VARCHAR END AS cand_bonbun, CASE WHEN o_custkey % 4 = 3 THEN (o_custkey % 2)::VARCHAR ELSE '' END AS cand_bubun,
  CASE WHEN o_orderkey % 2 = 0 THEN 'trade' ELSE 'rent' END AS transaction_type FROM (SELECT *, '단지' || (o_custkey % 400) || '마을' AS stem FROM orders)"""
_CAND_SQL = """SELECT gu, dong_norm, cand_norm, road_norm, cand_bonbun, cand_bubun, min(apartment_name) AS cand_name, min(road_address) AS cand_road, min(road_name) AS cand_road_name_norm,
  count(*) FILTER (transaction_type = 'trade') AS trade_count, count(*) FILTER (transaction_type = 'rent') AS rent_count,
  cand_bonbun || CASE WHEN cand_bubun NOT IN ('', '0') THEN '-' || cand_bubun ELSE '' END AS cand_jibun FROM md GROUP BY 1, 2, 3, 4, 5, 6"""
_MATCH_CTES = {"ms": _SITE_SQL, "md": _DEAL_SQL, "mc": _CAND_SQL}


def prepared(spark, d):
    """The written matching keys of the sites, and the written candidates."""
    sites = once(spark, f"match-sites:{d}", lambda: matching.prepare_sites(match_sites_table(spark, d)))
    return spread(sites), spread(once(spark, f"candidates:{d}", lambda: matching.candidates(match_deals_table(spark, d))))


@query("match_candidates", with_ctes("", "SELECT gu, dong_norm, cand_norm, road_norm, cand_bonbun, cand_bubun, cand_name, trade_count, rent_count FROM mc", _MATCH_CTES))
def match_candidates(spark, d):
    found = matching.candidates(match_deals_table(spark, d))
    return found.select("gu", "dong_norm", "cand_norm", "road_norm", "cand_bonbun", "cand_bubun", "cand_name", "trade_count", "rent_count")


_C_ORDER = "cand_name, cand_road NULLS FIRST, cand_jibun, cand_norm, cand_bonbun, cand_bubun, trade_count, rent_count"


def _block_sql(on: str, where: str, kind: str, high: float, low: float) -> str:
    """Unique, name-confirmed, contained or ambiguous: the best candidate of each site's block."""
    held = "length(name_norm) >= 4 AND length(cand_norm) >= 4 AND (contains(cand_norm, name_norm) OR contains(name_norm, cand_norm))"
    return f"""SELECT site_id, cand_name, CASE WHEN n = 1 THEN '{kind}' WHEN tier = 0 THEN '{kind}_name_confirmed' WHEN tier = 1 THEN '{kind}_candidate' ELSE '{kind}_ambiguous' END AS match_type,
    CASE WHEN n = 1 OR tier = 0 THEN {high}e0 ELSE {low}e0 END AS match_confidence FROM (
    SELECT *, count(*) OVER (PARTITION BY site_id) AS n, CASE WHEN cand_norm = name_norm THEN 0 WHEN {held} THEN 1 ELSE 2 END AS tier
    FROM ms JOIN mc ON {on} WHERE {where}) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY tier, {_C_ORDER}) = 1"""


_LOT_SQL = _block_sql(
    "mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm AND cand_bonbun = bonbun AND cand_bubun = bubun", "bonbun IS NOT NULL",
    "gu_dong_jibun_exact", 0.96, 0.80,
)
_NUMBER_SQL = _block_sql(
    "mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm AND cand_road_name_norm = road_name_norm AND regexp_replace(cand_jibun, '[^0-9]', '', 'g') = detail_norm",
    "road_name_norm <> ''", "gu_dong_road_number_exact", 0.97, 0.82,
)


def _shown(df):
    return df.select("site_id", F.col("_c.cand_name").alias("cand_name"), "match_type", "match_confidence")


@query("match_by_lot", with_ctes("", _LOT_SQL, _MATCH_CTES))
def match_by_lot(spark, d):
    sites, cands = prepared(spark, d)
    by_lot = cands.withColumns({"bonbun": F.col("cand_bonbun"), "bubun": F.col("cand_bubun")})
    return _shown(
        matching.block_branch(
            sites.where("bonbun IS NOT NULL"), by_lot, ("gu", "dong_norm", "bonbun", "bubun"), "gu_dong_jibun_exact", 2
        )
    )


@query("match_by_road_number", with_ctes("", _NUMBER_SQL, _MATCH_CTES))
def match_by_road_number(spark, d):
    sites, cands = prepared(spark, d)
    numbered = cands.withColumns(
        {"road_name_norm": F.col("cand_road_name_norm"), "detail_norm": F.regexp_replace("cand_jibun", "[^0-9]", "")}
    )
    return _shown(
        matching.block_branch(
            sites.where("road_name_norm <> ''"), numbered, ("gu", "dong_norm", "road_name_norm", "detail_norm"),
            "gu_dong_road_number_exact", 1,
        )
    )


@query(
    "match_by_name",
    with_ctes(
        "",
        f"""SELECT site_id, cand_name, CASE WHEN sure THEN 'gu_dong_name_exact_address_confirmed' ELSE 'gu_dong_name_exact_candidate' END AS match_type,
        CASE WHEN sure THEN 0.94e0 ELSE 0.72e0 END AS match_confidence FROM (SELECT site_id, cand_name, (ms.road_norm <> '' AND ms.road_norm = mc.road_norm) OR coalesce(cand_bonbun = bonbun AND cand_bubun = bubun, false) AS sure
        FROM ms JOIN mc ON mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm AND cand_norm = name_norm
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY cand_name DESC, cand_road DESC NULLS LAST, cand_jibun DESC, cand_norm DESC, cand_bonbun DESC, cand_bubun DESC) = 1)""",
        _MATCH_CTES,
    ),
)
def match_by_name(spark, d):
    sites, cands = prepared(spark, d)
    return _shown(matching.name_branch(sites, cands, 3))


@query(
    "match_by_containment",
    with_ctes(
        "",
        f"""SELECT site_id, cand_name, 'same_dong_contains_candidate' AS match_type, 0.78e0 AS match_confidence FROM ms JOIN mc ON mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm
        AND length(name_norm) >= 4 AND length(cand_norm) >= 4 AND (contains(cand_norm, name_norm) OR contains(name_norm, cand_norm))
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {_C_ORDER}) = 1""",
        _MATCH_CTES,
    ),
)
def match_by_containment(spark, d):
    sites, cands = prepared(spark, d)
    return _shown(matching.contains_branch(sites, cands, 4))


_NAME_SQL = """SELECT site_id, cand_name, CASE WHEN sure THEN 'gu_dong_name_exact_address_confirmed' ELSE 'gu_dong_name_exact_candidate' END AS match_type,
  CASE WHEN sure THEN 0.94e0 ELSE 0.72e0 END AS match_confidence FROM (SELECT site_id, cand_name, (ms.road_norm <> '' AND ms.road_norm = mc.road_norm) OR coalesce(cand_bonbun = bonbun AND cand_bubun = bubun, false) AS sure
  FROM ms JOIN mc ON mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm AND cand_norm = name_norm
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY cand_name DESC, cand_road DESC NULLS LAST, cand_jibun DESC, cand_norm DESC, cand_bonbun DESC, cand_bubun DESC) = 1)"""
_HELD_SQL = f"""SELECT site_id, cand_name, 'same_dong_contains_candidate' AS match_type, 0.78e0 AS match_confidence FROM ms JOIN mc ON mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm
  AND length(name_norm) >= 4 AND length(cand_norm) >= 4 AND (contains(cand_norm, name_norm) OR contains(name_norm, cand_norm))
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {_C_ORDER}) = 1"""
_ROAD_SQL = """SELECT site_id, CASE WHEN n = 1 OR same THEN cand_name END AS cand_name,
  'road_address_exact' || CASE WHEN n = 1 THEN '' WHEN same THEN '_name_confirmed' ELSE '_score_verified' END AS match_type,
  CASE WHEN n = 1 THEN 0.98e0 ELSE 0.86e0 END AS match_confidence FROM (
  SELECT *, count(*) OVER (PARTITION BY site_id) AS n, cand_norm = name_norm AS same FROM ms JOIN mc ON mc.gu = ms.gu AND mc.road_norm = ms.road_norm WHERE ms.road_norm <> '')
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY same DESC, trade_count + rent_count DESC, cand_name DESC, cand_road DESC, cand_jibun DESC) = 1"""
_CASCADE_SQL = f"""SELECT ms.site_id, CASE WHEN match_type <> 'road_address_exact_score_verified' THEN cand_name END AS cand_name, coalesce(match_type, 'unmatched') AS match_type,
  coalesce(match_confidence, 0) AS match_confidence, CASE WHEN starts_with(match_type, 'road_address') OR ends_with(match_type, '_confirmed') OR match_type IN ('gu_dong_road_number_exact', 'gu_dong_jibun_exact') THEN 'Y' ELSE 'N' END AS verified
  FROM ms LEFT JOIN (SELECT * FROM ({_ROAD_SQL.replace('SELECT site_id,', 'SELECT 0 AS p, site_id,', 1)})
  UNION ALL SELECT 1, * FROM ({_NUMBER_SQL}) UNION ALL SELECT 2, * FROM ({_LOT_SQL}) UNION ALL SELECT 3, * FROM ({_NAME_SQL}) UNION ALL SELECT 4, * FROM ({_HELD_SQL})) b
  ON b.site_id = ms.site_id QUALIFY row_number() OVER (PARTITION BY ms.site_id ORDER BY p) = 1"""


@query("match_cascade", with_ctes("", _CASCADE_SQL, _MATCH_CTES))
def match_cascade(spark, d):
    """All five branches. The name that similarity chose is left out: SQL cannot measure it."""
    found = matching.cascade(*prepared(spark, d))
    by_rule = F.when(F.col("match_type") != "road_address_exact_score_verified", F.col("cand_name"))
    return found.select("site_id", by_rule.alias("cand_name"), "match_type", "match_confidence", "verified")


def mapping(spark, d):
    """The written mapping; reports read it."""
    return spread(once(spark, f"mapping:{d}", lambda: build_mapping(spark, d)))


def build_mapping(spark, d):
    sites, cands = prepared(spark, d)
    overrides = match_sites_table(spark, d).where("site_id % 50 = 1").select(
        "site_id", F.concat(F.lit("확정"), "name").alias("cand_name"), F.col("road_address").alias("cand_road"),
        F.col("jibun").alias("cand_jibun"),
    )
    rejects = match_sites_table(spark, d).where("site_id % 17 = 2").select("site_id", "name").withColumnRenamed("name", "cand_name")
    return matching.match_sites(sites, cands, overrides, rejects)


_AUDIT_CTES = _MATCH_CTES | sql_matching.ctes(GENERIC_NAMES)
#: The WITH of the reverse audit goes on where that of the audit ends.
_REVERSE = f"SELECT * FROM ({sql_matching.reverse(GENERIC_NAMES)})"


@query("match_mapping", with_ctes("", sql_matching.MAPPING, _AUDIT_CTES))
def match_mapping(spark, d):
    return build_mapping(spark, d).select("site_id", "cand_name", "match_type", "match_confidence", "verified", "manual_override")


@query("match_aliases", with_ctes("", sql_matching.ALIASES, _AUDIT_CTES))
def match_aliases(spark, d):
    found = matching.alias_approvals(*prepared(spark, d))
    return found.select("site_id", "name_norm", "cand_norm", "similarity")


def audited(spark, d):
    """The written audit; review reports read it."""
    return spread(once(spark, f"audit:{d}", lambda: build_audit(spark, d)))


def build_audit(spark, d):
    return matching.audit(mapping(spark, d), prepared(spark, d)[1])


@query("match_audit", with_ctes("", sql_matching.AUDIT, _AUDIT_CTES))
def match_audit(spark, d):
    return build_audit(spark, d).select(
        "site_id", "status", "reason", "evidence", "recommended_action", "lot_count", "dong_count", "best_similarity"
    )


@query("match_reasons", with_ctes("", sql_matching.REASONS, _AUDIT_CTES))
def match_reasons(spark, d):
    return matching.reason_summary(audited(spark, d))


@query("match_alias_report", with_ctes("", sql_matching.alias_report(GENERIC_NAMES), _AUDIT_CTES))
def match_alias_report(spark, d):
    rows = audited(spark, d)
    alias = matching.alias_report(rows).select("site_id", "candidate", "score", "recommended_action")
    quick = matching.quick_review(rows).select("site_id", "candidate", "score", "recommended_action")
    return alias.withColumn("report", F.lit("alias")).unionByName(quick.withColumn("report", F.lit("quick")))


@query("match_same_lot", with_ctes("", sql_matching.SAME_LOT, _AUDIT_CTES))
def match_same_lot(spark, d):
    return matching.same_lot_review(audited(spark, d), prepared(spark, d)[1])


@query("match_missing_lot", with_ctes("", sql_matching.MISSING_LOT, _AUDIT_CTES))
def match_missing_lot(spark, d):
    return matching.missing_lot_report(audited(spark, d), match_sites_table(spark, d))


@query("match_risks", with_ctes("", sql_matching.RISKS, _AUDIT_CTES))
def match_risks(spark, d):
    return matching.risk_summary(matching.verified_audit(mapping(spark, d)))


@query("match_reverse_audit", with_ctes("", _REVERSE, _AUDIT_CTES))
def match_reverse_audit(spark, d):
    sites, cands = prepared(spark, d)
    reverse = matching.reverse_audit(audited(spark, d), sites, cands)
    return matching.review_batch(reverse).select("site_id", "reverse_type", "recommended_action", "matched_master", "place")


def trusted_map(spark, d):
    """A mapping by rule: most sites point at their own record, some at another dong, some nowhere."""
    key = F.col("site_id")
    return match_sites_table(spark, d).select(
        "site_id", "name", "gu", F.when(key % 9 == 4, "다른동").otherwise(F.col("dong")).alias("dong"),
        F.concat(F.lit("단지"), (key % 400).cast("string"), F.lit("마을")).alias("cand_name"),
        F.when(key % 2 == 0, F.col("road_address")).alias("cand_road"),
        F.when(key % 5 == 0, 0.5).otherwise(0.95).alias("match_confidence"), F.lit("N").alias("verified"), F.lit("N").alias("manual_override"),
    )


_ATTACH = """SELECT site_id, d.* FROM (
  SELECT site_id, gu, CASE WHEN site_id % 9 = 4 THEN '다른동' ELSE dong_norm END AS dn, '단지' || (site_id % 400) || '마을' AS nn,
  CASE WHEN site_id % 2 = 0 THEN road_norm ELSE '' END AS rn FROM ms WHERE site_id % 5 <> 0) w
  JOIN (SELECT gu AS dgu, dong_norm AS ddn, cand_norm AS dnn, road_norm AS drn, transaction_type FROM md) d ON dgu = gu AND dnn = nn
  AND CASE WHEN EXISTS (SELECT 1 FROM md x WHERE x.gu = w.gu AND x.dong_norm = dn AND x.cand_norm = nn AND x.road_norm = rn) THEN ddn = dn AND drn = rn
  WHEN EXISTS (SELECT 1 FROM md x WHERE x.gu = w.gu AND x.dong_norm = dn AND x.cand_norm = nn) THEN ddn = dn
  ELSE (SELECT count(DISTINCT x.dong_norm) FROM md x WHERE x.gu = w.gu AND x.cand_norm = nn) = 1 END"""


@query(
    "deal_attach",
    with_ctes("", f"SELECT site_id, count(*) AS deals, count(*) FILTER (transaction_type = 'trade') AS trades FROM ({_ATTACH}) GROUP BY 1", _MATCH_CTES),
)
def deal_attach(spark, d):
    found = matching.attach_deals(trusted_map(spark, d), match_deals_table(spark, d))
    return found.groupBy("site_id").agg(
        F.count("*").alias("deals"), F.count_if(F.col("transaction_type") == "trade").alias("trades")
    )


@query(
    "dong_mismatch",
    with_ctes(
        "",
        """SELECT site_id, dongs AS deal_dongs, n AS row_count, CASE WHEN k = 1 THEN 'rescued' ELSE 'held' END AS status FROM (
        SELECT site_id, gu, CASE WHEN site_id % 9 = 4 THEN '다른동' ELSE dong_norm END AS dn, '단지' || (site_id % 400) || '마을' AS nn FROM ms WHERE site_id % 5 <> 0) w
        JOIN (SELECT gu, cand_norm AS nn, string_agg(DISTINCT dong_norm, '|' ORDER BY dong_norm) AS dongs, count(DISTINCT dong_norm) AS k, count(*) AS n FROM md GROUP BY 1, 2) USING (gu, nn)
        WHERE NOT EXISTS (SELECT 1 FROM md x WHERE x.gu = w.gu AND x.dong_norm = dn AND x.cand_norm = nn)""",
        _MATCH_CTES,
    ),
)
def dong_mismatch(spark, d):
    found = matching.dong_mismatch(trusted_map(spark, d), match_deals_table(spark, d))
    return found.select("site_id", "deal_dongs", "row_count", "status")


@query(
    "live_name_match",
    with_ctes(
        "",
        """SELECT DISTINCT site_id, cand_norm AS deal_norm, md.dong_norm FROM ms JOIN (SELECT DISTINCT cand_norm, dong_norm FROM md) md ON cand_norm = name_norm
        OR (md.dong_norm = ms.dong_norm AND length(cand_norm) >= 4 AND length(name_norm) >= 4 AND (contains(cand_norm, name_norm) OR contains(name_norm, cand_norm)))""",
        _MATCH_CTES,
    ),
)
def live_name_match(spark, d):
    return matching.live_name_match(match_sites_table(spark, d), match_deals_table(spark, d))


@query(
    "resolve_school",
    """SELECT zone, first(school ORDER BY zone <> school, school) AS school, bool_or(zone = school) AS exact FROM (
    SELECT DISTINCT 'widget ' || p_size AS zone FROM part UNION SELECT DISTINCT p_name FROM part), (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' annex' END AS school FROM part)
    WHERE contains(school, zone) OR contains(zone, school) GROUP BY 1""",
)
def resolve_school(spark, d):
    part = t.read(spark, d, "part")
    zones = part.select(F.concat(F.lit("widget "), F.col("p_size").cast("string")).alias("zone")).union(part.select("p_name")).distinct()
    suffix = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(" annex")
    schools = part.select(F.concat("p_name", suffix).alias("school")).distinct()
    return search.resolve_school(zones, schools)


@query(
    "name_evidence",
    with_ctes(
        "",
        """SELECT site_id, name_norm, cand_norm, len(a) > 0 AND len(b) > 0 AND a <> b AS conflict, (len(a) > 0) <> (len(b) > 0) AS asymmetry,
        CASE WHEN starts_with(cand_norm, dong_norm) AND length(cand_norm) > length(dong_norm) + 1 THEN substr(cand_norm, length(dong_norm) + 1) ELSE cand_norm END AS stripped FROM (
        SELECT DISTINCT site_id, name_norm, cand_norm, ms.dong_norm, list_sort(list_distinct(regexp_extract_all(name_norm, '[0-9]+'))) AS a, list_sort(list_distinct(regexp_extract_all(cand_norm, '[0-9]+'))) AS b
        FROM ms JOIN mc ON mc.gu = ms.gu AND mc.dong_norm = ms.dong_norm AND cand_bonbun = bonbun AND cand_bubun = bubun)""",
        _MATCH_CTES,
    ),
)
def name_evidence(spark, d):
    """Numbers and neighbourhood prefixes in the names of one lot."""
    return matching.lot_evidence(*prepared(spark, d))
