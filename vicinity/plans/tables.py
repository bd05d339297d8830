"""The domain tables, derived from the given tables by integer arithmetic.

Each table exists twice: as a DataFrame here, and as the same derivation in SQL (``CTES``), so
a query and its check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hand-drawn districts, rings of (lat, lng) corners; the last one is concave.
DISTRICTS: dict[str, list[tuple[float, float]]] = {
    "north_west": [(37.565, 126.81), (37.645, 126.815), (37.64, 126.905), (37.56, 126.9)],
    "north": [(37.56, 126.9), (37.64, 126.905), (37.645, 127.0), (37.555, 126.995)],
    "north_east": [(37.555, 126.995), (37.645, 127.0), (37.638, 127.09), (37.55, 127.085)],
    "south_west": [(37.46, 126.812), (37.565, 126.81), (37.56, 126.9), (37.465, 126.895)],
    "south": [(37.465, 126.895), (37.56, 126.9), (37.555, 126.995), (37.458, 126.99)],
    "south_east": [
        (37.458, 126.99), (37.555, 126.995), (37.55, 127.085), (37.51, 127.088), (37.505, 127.03),
        (37.48, 127.035), (37.47, 127.08),
    ],
}
# School zones: (shared, name, ring). Shared zones overlap the normal ones.
SCHOOL_ZONES: list[tuple[bool, str, list[tuple[float, float]]]] = [
    (False, "zone_a", [(37.47, 126.82), (37.56, 126.83), (37.555, 126.93), (37.475, 126.92)]),
    (False, "zone_b", [(37.475, 126.92), (37.555, 126.93), (37.55, 127.06), (37.47, 127.05)]),
    (False, "zone_c", [(37.556, 126.83), (37.64, 126.82), (37.62, 127.06), (37.59, 126.95), (37.551, 127.05)]),
    (True, "zone_d", [(37.5, 126.88), (37.6, 126.87), (37.6, 126.98), (37.5, 126.99)]),
    (True, "zone_e", [(37.46, 127.0), (37.64, 127.01), (37.64, 127.09), (37.46, 127.08)]),
]

LAYERS = ("academy", "hospital", "bus_stop", "subway", "cafe")
LAYER_RADIUS = {"academy": 1000, "hospital": 500, "bus_stop": 500, "subway": 500, "cafe": 300}
AS_OF = "2001-11-30"


# Stated so that no job has to open the files just to learn their columns.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def _lat(key: str, step: int) -> Column:
    return F.expr(f"37.45D + ({key} * {step} % 20011) / 100000D")


def _lng(key: str, step: int) -> Column:
    return F.expr(f"126.80D + ({key} * {step} % 30011) / 100000D")


def site(spark, d) -> DataFrame:
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    key = F.col("c_custkey")
    return read(spark, d, "customer").join(nation, "c_nationkey").select(
        key.alias("site_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("gu"),
        F.col("c_mktsegment").alias("dong"),
        _lat("c_custkey", 7919).alias("lat"),
        _lng("c_custkey", 104729).alias("lng"),
        (F.lit(50) + key * 37 % 2000).alias("households"),
        (key % 11 == 0).alias("is_rental"),
    )


def poi(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (key % 5 + 1).cast("int"))
    return read(spark, d, "part").select(
        key.alias("poi_id"),
        layer.alias("layer"),
        F.col("p_type").alias("subtype"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.lit(1.0).alias("weight"),
        _lat("p_partkey", 6007).alias("lat"),
        _lng("p_partkey", 15485863).alias("lng"),
    )


def anchor(spark, d) -> DataFrame:
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, d, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("poi_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("gu"),
        F.col("s_acctbal").alias("balance"),
        _lat("s_suppkey", 6007).alias("lat"),
        _lng("s_suppkey", 15485863).alias("lng"),
    )


def camera(spark, d) -> DataFrame:
    """Dense layer; three keys share one pole, agencies differ in how they register."""
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        key.alias("poi_id"),
        (F.col("o_custkey") % 25).alias("agency"),
        F.when(F.col("o_custkey") % 25 < 8, F.lit(1)).otherwise(1 + key % 4).cast("long").alias("cameras"),
        F.col("o_orderpriority").alias("purpose"),
        F.when(F.col("o_custkey") % 2 == 0, key - key % 3).otherwise(key).alias("pole"),
    ).select(
        "poi_id", "agency", "cameras", "purpose",
        _lat("pole", 6007).alias("lat"), _lng("pole", 15485863).alias("lng"),
    )


def route(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("node_id"),
        (F.col("l_partkey") % 400).cast("string").alias("route_name"),
    )


def deal(spark, d) -> DataFrame:
    """Sale, jeonse and monthly deals of sites; amounts in units of 10,000."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    flag = F.col("l_returnflag")
    amount = F.rint("l_extendedprice").cast("long")
    return read(spark, d, "lineitem").join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("site_id"),
        F.col("l_orderkey").alias("deal_key"),
        F.when(flag == "R", "trade").otherwise("rent").alias("transaction_type"),
        F.when(flag == "R", "sale").when(flag == "A", "jeonse").otherwise("monthly").alias("filter_type"),
        F.col("l_shipdate").cast("date").alias("deal_date"),
        F.when(flag == "R", amount).alias("deal_amount"),
        F.when(flag != "R", amount).alias("deposit_amount"),
        F.when(flag == "N", (F.col("l_partkey") % 90 + 10)).when(flag == "A", F.lit(0)).cast("long").alias("monthly_rent"),
        (F.lit(20.0) + F.col("l_quantity") * 2).alias("area_m2"),
        F.col("l_linenumber").alias("floor"),
    )


def event(spark, d) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("ts").cast("date").alias("day"),
        F.col("user_id").cast("string").alias("visitor_hash"),
        "event_type",
        F.get_json_object("props", "$.k").alias("combo_key"),
        F.col("value").cast("double").alias("result_count"),
        (F.col("user_id") % 40).alias("site_id"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("home", "explore", "map")]),
            (F.col("event_id") % 3 + 1).cast("int"),
        ).alias("src"),
    )


def _ring_rows(rings) -> list[tuple]:
    rows = []
    for k, (shared, name, ring) in enumerate(rings):
        closed = [*ring, ring[0]]
        rows += [(name, k, shared, *a, *b) for a, b in zip(closed, closed[1:]) if a != b]
    return rows


DISTRICT_EDGES = _ring_rows([(False, name, ring) for name, ring in DISTRICTS.items()])
ZONE_EDGES = _ring_rows(SCHOOL_ZONES)
_EDGE_SCHEMA = "polygon string, ord int, shared boolean, lat1 double, lng1 double, lat2 double, lng2 double"


def district_edges(spark) -> DataFrame:
    return spark.createDataFrame(DISTRICT_EDGES, _EDGE_SCHEMA)


def zone_edges(spark) -> DataFrame:
    return spark.createDataFrame(ZONE_EDGES, _EDGE_SCHEMA)


def _edge_sql(rows) -> str:
    values = ", ".join(
        f"('{n}', {k}, {str(s).lower()}, {a!r}e0, {b!r}e0, {c!r}e0, {e!r}e0)" for n, k, s, a, b, c, e in rows
    )
    return f"SELECT * FROM (VALUES {values}) t(polygon, ord, shared, lat1, lng1, lat2, lng2)"


_LAYER_CASE = "CASE p_partkey % 5 " + " ".join(
    f"WHEN {k} THEN '{name}'" for k, name in enumerate(LAYERS)
) + " END"

CTES = {
    "site": """SELECT c_custkey AS site_id, c_name AS name, n_name AS gu, c_mktsegment AS dong,
  37.45e0 + (c_custkey*7919 % 20011)/100000e0 AS lat,
  126.80e0 + (c_custkey*104729 % 30011)/100000e0 AS lng,
  50 + c_custkey*37 % 2000 AS households, c_custkey % 11 = 0 AS is_rental
  FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "poi": f"""SELECT p_partkey AS poi_id, {_LAYER_CASE} AS layer, p_type AS subtype,
  p_brand AS brand, p_name AS name, 1e0 AS weight,
  37.45e0 + (p_partkey*6007 % 20011)/100000e0 AS lat,
  126.80e0 + (p_partkey*15485863 % 30011)/100000e0 AS lng FROM part""",
    "anchor": """SELECT s_suppkey AS poi_id, s_name AS name, n_name AS gu, s_acctbal AS balance,
  37.45e0 + (s_suppkey*6007 % 20011)/100000e0 AS lat,
  126.80e0 + (s_suppkey*15485863 % 30011)/100000e0 AS lng
  FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "camera": """SELECT poi_id, agency, cameras, purpose,
  37.45e0 + (pole*6007 % 20011)/100000e0 AS lat,
  126.80e0 + (pole*15485863 % 30011)/100000e0 AS lng FROM (
  SELECT o_orderkey AS poi_id, o_custkey % 25 AS agency, o_orderpriority AS purpose,
  CASE WHEN o_custkey % 25 < 8 THEN 1 ELSE 1 + o_orderkey % 4 END AS cameras,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderkey - o_orderkey % 3 ELSE o_orderkey END AS pole
  FROM orders)""",
    "route": """SELECT l_suppkey AS node_id, CAST(l_partkey % 400 AS VARCHAR) AS route_name
  FROM lineitem""",
    "deal": """SELECT o_custkey AS site_id, l_orderkey AS deal_key,
  CASE WHEN l_returnflag='R' THEN 'trade' ELSE 'rent' END AS transaction_type,
  CASE l_returnflag WHEN 'R' THEN 'sale' WHEN 'A' THEN 'jeonse' ELSE 'monthly' END AS filter_type,
  CAST(l_shipdate AS DATE) AS deal_date,
  CASE WHEN l_returnflag='R' THEN CAST(round_even(l_extendedprice,0) AS BIGINT) END AS deal_amount,
  CASE WHEN l_returnflag<>'R' THEN CAST(round_even(l_extendedprice,0) AS BIGINT) END AS deposit_amount,
  CASE l_returnflag WHEN 'N' THEN l_partkey % 90 + 10 WHEN 'A' THEN 0 END AS monthly_rent,
  20e0 + l_quantity*2 AS area_m2, l_linenumber AS floor
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "event": """SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS visitor_hash,
  event_type, json_extract_string(props,'$.k') AS combo_key, CAST(value AS DOUBLE) AS result_count,
  user_id % 40 AS site_id,
  CASE event_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'explore' ELSE 'map' END AS src FROM events""",
}

CTES["district_edge"] = _edge_sql(DISTRICT_EDGES)
CTES["zone_edge"] = _edge_sql(ZONE_EDGES)

def _num(x: float) -> str:
    text = repr(x)
    return text if "e" in text else text + "e0"


SQL_CI = f"CAST(floor((lat - 37.4e0) / {_num(100.0 / 111000.0)}) AS INT)"
SQL_CJ = f"CAST(floor((lng - 126.75e0) / {_num(100.0 / 88800.0)}) AS INT)"
SQL_CLAT = f"(37.4e0 + (i + 0.5e0) * {_num(100.0 / 111000.0)})"
SQL_CLNG = f"(126.75e0 + (j + 0.5e0) * {_num(100.0 / 88800.0)})"
SQL_D2 = (
    f"(({SQL_CLNG} - lng) * 88800e0) * (({SQL_CLNG} - lng) * 88800e0) + "
    f"(({SQL_CLAT} - lat) * 111000e0) * (({SQL_CLAT} - lat) * 111000e0)"
)


def sql_disk(source: str, radius: str, span: int) -> str:
    """Cells whose centre lies within the radius of each row of ``source``, with ``d2``."""
    return (
        f"SELECT *, {SQL_D2} AS d2 FROM (SELECT s.*, {SQL_CI} + di AS i, {SQL_CJ} + dj AS j "
        f"FROM {source} s, range(-{span}, {span + 1}) a(di), range(-{span}, {span + 1}) b(dj)) "
        f"WHERE {SQL_D2} <= {radius} * {radius}"
    )


_RADIUS_CASE = "CASE layer " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LAYER_RADIUS.items()) + " END"
CTES["member"] = (
    "SELECT site_id, gu, dong, i, j, d2, d2 <= 250000e0 AS in_core FROM (" + sql_disk("site", "1000e0", 11) + ")"
)
CTES["raster"] = f"""SELECT i, j, last(polygon ORDER BY ord) AS polygon FROM (
  SELECT polygon, ord, i, unnest(range(CAST(floor((x - 126.75e0) / {_num(100.0 / 88800.0)}) AS BIGINT),
    CAST(floor((x2 - 126.75e0) / {_num(100.0 / 88800.0)}) AS BIGINT) + 1)) AS j FROM (
  SELECT *, row_number() OVER w AS k, lead(x) OVER w AS x2 FROM (
  SELECT polygon, ord, i, lng1 + (la - lat1) / (lat2 - lat1) * (lng2 - lng1) AS x FROM (
  SELECT *, 37.4e0 + (i + 0.5e0) * {_num(100.0 / 111000.0)} AS la FROM district_edge, range(-60, 420) r(i))
  WHERE (lat1 <= la AND la < lat2) OR (lat2 <= la AND la < lat1))
  WINDOW w AS (PARTITION BY ord, polygon, i ORDER BY x)) WHERE k % 2 = 1 AND x2 IS NOT NULL) GROUP BY i, j"""
CTES["border"] = """SELECT i, j, CAST(100 * coalesce(least(
  min(g - i) OVER (PARTITION BY j ORDER BY i ROWS UNBOUNDED PRECEDING) + i,
  min(g + i) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i), 0) AS INT) AS border_m
  FROM (SELECT i, j, least(
    j - max(CASE WHEN polygon IS NULL THEN j END) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING),
    min(CASE WHEN polygon IS NULL THEN j END) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - j) AS g
  FROM (SELECT i, j FROM range(-39, 395) a(i), range(-23, 422) b(j)) LEFT JOIN raster USING (i, j))"""
CTES["zone"] = """SELECT i, j, in_core, site_count, coalesce(polygon, gu0) AS gu, dong, coalesce(border_m, 0) AS border_m
  FROM (SELECT i, j, max(in_core) AS in_core, count(*) AS site_count,
  first(gu ORDER BY d2, site_id) AS gu0, first(dong ORDER BY d2, site_id) AS dong FROM member GROUP BY 1, 2)
  LEFT JOIN raster USING (i, j) LEFT JOIN border USING (i, j)"""
CTES["cov"] = (
    "SELECT i, j, layer, subtype, CAST(count(*) AS DOUBLE) AS count FROM ("
    + sql_disk(f"(SELECT *, {_RADIUS_CASE} AS r FROM poi)", "CAST(r AS DOUBLE)", 11)
    + ") SEMI JOIN zone USING (i, j) GROUP BY 1, 2, 3, 4"
)
CTES["cellcount"] = (
    f"SELECT i, j, layer, subtype, CAST(count(*) AS DOUBLE) AS count FROM (SELECT *, {SQL_CI} AS i, {SQL_CJ} AS j FROM poi) "
    "SEMI JOIN zone USING (i, j) GROUP BY 1, 2, 3, 4"
)
CTES["hh"] = (
    "SELECT i, j, radius_m, CAST(sum(households) AS BIGINT) AS households FROM ("
    + sql_disk("(SELECT * FROM site WHERE households > 0)", "1000e0", 11)
    + "), (VALUES (300), (500), (1000)) v(radius_m) WHERE d2 <= radius_m * radius_m "
    "AND (i, j) IN (SELECT (i, j) FROM zone) GROUP BY 1, 2, 3"
)
CTES["near"] = f"""SELECT i, j, layer, CAST(round_even(sqrt(min(q)), 0) AS INT) AS distance_m FROM (
  SELECT i, j, layer, power(({SQL_CLAT} - lat) * 111000e0, 2) + power(({SQL_CLNG} - lng) * 88800e0, 2) AS q
  FROM zone JOIN (SELECT layer, lat, lng FROM poi WHERE layer IN ('hospital', 'subway')) p
  ON abs({SQL_CLAT} - lat) * 111000e0 <= 3000 AND abs({SQL_CLNG} - lng) * 88800e0 <= 3000)
  WHERE q <= 9000000 GROUP BY 1, 2, 3"""
GRID_CTES = "site poi district_edge raster border member zone"

# Great-circle whole metres between two aliased rows, in SQL.
def sql_metres(a: str, b: str) -> str:
    return f"CAST(round_even({sql_raw_metres(a, b)}, 0) AS INT)"


def sql_raw_metres(a: str, b: str) -> str:
    h = (
        f"(power(sin(radians({b}.lat-{a}.lat)/2),2)"
        f"+cos(radians({a}.lat))*cos(radians({b}.lat))*power(sin(radians({b}.lng-{a}.lng)/2),2))"
    )
    return f"(12742000e0*atan2(sqrt({h}),sqrt(1-{h})))"


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named tables, then ``extra`` ones, then ``body``."""
    parts = [(n, CTES[n]) for n in names.split()] + list((extra or {}).items())
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" + body
