"""Queries on scores: ranking, domain and area profiles, comparison, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.display import summary_score
from ..operators import areas, baseline, insights, radius, ranking, scoring
from ..session import once, spread
from . import tables as t
from .registry import query
from .tables import sql_metres, with_ctes

CATEGORIES = {"academy": "academy", "hospital": "hospital", "bus_stop": "bus", "subway": "subway", "cafe": "cafe"}
DIRECTIONS = {**{v: "higher" for v in CATEGORIES.values()}, "hangang": "lower"}
PREFERENCES = {"subway": 5, "academy": 4, "hospital": 3, "cafe": 1, "hangang": 2, "bus": 0}

SCORE_CTES = {
    "metric": "SELECT s.site_id, any_value(s.name) AS name, any_value(s.gu) AS gu, any_value(s.dong) AS dong, "
    + ", ".join(f"count(p.d) FILTER (layer = '{k}') AS {v}" for k, v in CATEGORIES.items())
    + f", any_value(a.d) AS hangang FROM site s LEFT JOIN (SELECT s.site_id, p.layer, {sql_metres('s', 'p')} AS d "
    f"FROM site s, poi p WHERE {sql_metres('s', 'p')} <= 1000) p USING (site_id) LEFT JOIN ("
    f"SELECT s.site_id, min({sql_metres('s', 'a')}) AS d FROM site s, anchor a WHERE {sql_metres('s', 'a')} <= 3000 "
    "GROUP BY 1) a USING (site_id) GROUP BY 1",
    "melted": "SELECT site_id, category, v FROM metric UNPIVOT (v FOR category IN (academy, hospital, bus, subway, cafe, hangang))",
    "scored": """SELECT site_id, category, CAST(v AS DOUBLE) AS value, round_even(p*100,0)/100e0 AS pct, round_even((100-p)*100,0)/100e0 AS score
      FROM (SELECT *, (CASE category WHEN 'hangang' THEN below ELSE n-below-ties END + 0.5e0*ties)/n*100 AS p FROM (
      SELECT *, rank() OVER (PARTITION BY category ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY category, v) AS ties,
      count(*) OVER (PARTITION BY category) AS n FROM melted))""",
    "everything": """SELECT site_id, category, value, pct, score FROM (
      SELECT site_id, category FROM metric UNPIVOT INCLUDE NULLS (v FOR category IN (academy, hospital, bus, subway, cafe, hangang)))
      LEFT JOIN scored USING (site_id, category)""",
}
_DOMAIN_CASE = "CASE category " + " ".join(f"WHEN '{c}' THEN '{areas.CATEGORY_DOMAIN[c]}'" for c in DIRECTIONS) + " END"
_WEIGHT_CASE = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in areas.DOMAIN_WEIGHTS.items()) + " END"
_PLACE_CASE = "CASE domain " + " ".join(f"WHEN '{k}' THEN {n + 1}" for n, k in enumerate(areas.DOMAIN_ORDER)) + " END"


def _grade_sql(value: str, bands=rules.DOMAIN_GRADES) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {n} THEN '{g}'" for n, g in bands) + " ELSE 'D' END"


_REP = f"CAST(round_even(sum(score * {_WEIGHT_CASE}) / sum({_WEIGHT_CASE}), 0) AS INT)"
DOMAIN_CTES = {
    **SCORE_CTES,
    "dom": f"""SELECT site_id, name, gu, dong, domain, CAST(round_even(avg(score), 0) AS INT) AS score FROM (
      SELECT site_id, {_DOMAIN_CASE} AS domain, score FROM scored) JOIN (SELECT site_id, name, gu, dong FROM site) USING (site_id)
      GROUP BY ALL""",
    "prof": f"SELECT site_id, name, gu, dong, {_REP} AS representative FROM dom GROUP BY ALL",
    "area": """SELECT CASE WHEN grouping(dong) = 1 THEN 'gu' ELSE 'dong' END AS level, gu, dong, domain,
      CAST(round_even(avg(score), 0) AS INT) AS score, count(*) AS sample_count
      FROM dom GROUP BY GROUPING SETS ((gu, domain), (gu, dong, domain))""",
    "aprof": f"""SELECT c.level, c.gu, c.dong, c.site_count, coalesce(f.n, 0) AS scored_count,
      coalesce(nullif(s.rep, 0), f.m, 0) AS representative FROM (
      SELECT CASE WHEN grouping(dong) = 1 THEN 'gu' ELSE 'dong' END AS level, gu, dong, count(*) AS site_count
      FROM site GROUP BY GROUPING SETS ((gu), (gu, dong))) c
      LEFT JOIN (SELECT level, gu, dong, {_REP} AS rep FROM area GROUP BY ALL) s
      ON s.level = c.level AND s.gu = c.gu AND s.dong IS NOT DISTINCT FROM c.dong
      LEFT JOIN (SELECT CASE WHEN grouping(dong) = 1 THEN 'gu' ELSE 'dong' END AS level, gu, dong, count(*) AS n,
      CAST(round_even(avg(nullif(representative, 0)), 0) AS INT) AS m FROM prof GROUP BY GROUPING SETS ((gu), (gu, dong))) f
      ON f.level = c.level AND f.gu = c.gu AND f.dong IS NOT DISTINCT FROM c.dong""",
}
_BASE = "site poi anchor"


def metrics(spark, d):
    """The written baseline: places per layer within 1 km, and metres to the nearest anchor."""
    return spread(once(spark, f"metrics:{d}", lambda: build_metrics(spark, d)))


def build_metrics(spark, d, limit_m: int = 3000):
    """One row per site, from two distance joins."""
    sites = t.site(spark, d)
    counts = baseline.subtype_counts(
        sites.select("site_id", "name", "gu", "dong", "lat", "lng"), t.poi(spark, d), CATEGORIES, 1000, subtype="layer",
        nearest=False,
    )
    near = radius.nearest_within(sites, t.anchor(spark, d), limit_m).select(
        "site_id", F.col("distance_m").alias("hangang")
    )
    return counts.select(
        "site_id", "name", "gu", "dong", *[F.col(f"{v}_count").alias(v) for v in CATEGORIES.values()]
    ).join(near, "site_id", "left")


def scores(spark, d):
    """The written scores, long, with the site columns."""
    return spread(once(spark, f"scores:{d}", lambda: build_scores(spark, d)))


def build_scores(spark, d):
    """Mid-rank scores of every metric of the baseline."""
    wide = metrics(spark, d)
    long = scoring.mid_rank_long(wide, DIRECTIONS).withColumnRenamed("metric", "category")
    return long.join(wide.select("site_id", "name", "gu", "dong"), "site_id")


def domains(spark, d):
    return areas.site_domains(scores(spark, d))


@query(
    "midrank_all_metrics",
    with_ctes(_BASE, "SELECT * FROM everything", SCORE_CTES),
)
def midrank_all_metrics(spark, d):
    """Missing values have no rank, but stay rows."""
    return build_scores(spark, d).select("site_id", "category", "value", "pct", "score")


_WEIGHTED = "CAST(round_even(coalesce(sum(score * w) / nullif(sum(w), 0), 0), 0) AS INT)"
_WEIGHTS = ", ".join(f"('{k}', {v}e0)" for k, v in PREFERENCES.items() if v > 0)


@query(
    "weighted_rank_topk",
    with_ctes(
        _BASE,
        f"""SELECT site_id, name, gu, dong, {_WEIGHTED} AS score FROM site
        LEFT JOIN (scored JOIN (VALUES {_WEIGHTS}) v(category, w) USING (category)) USING (site_id)
        GROUP BY ALL ORDER BY score DESC, gu, dong, name LIMIT 10""",
        SCORE_CTES,
    ),
)
def weighted_rank_topk(spark, d):
    long = scores(spark, d)
    maps = ranking.score_maps(long, ("site_id", "name", "gu", "dong"))
    top = ranking.rank_sites(maps, PREFERENCES, 10)
    return top.select("site_id", "name", "gu", "dong", "score")


@query(
    "site_score_maps",
    with_ctes(
        _BASE,
        """SELECT site_id, string_agg(category || '=' || CAST(CAST(round_even(score * 100, 0) AS BIGINT) AS VARCHAR), ';' ORDER BY category) AS scores,
        count(*) AS n FROM scored WHERE category IN ('subway', 'cafe') GROUP BY 1""",
        SCORE_CTES,
    ),
)
def site_score_maps(spark, d):
    """Two separate scored baselines merged into one map per site."""
    wide = metrics(spark, d)
    parts = {c: scoring.mid_rank(wide, c, "higher") for c in ("subway", "cafe")}
    maps = ranking.site_scores(parts)
    entry = lambda e: F.concat_ws("=", e["key"], F.rint(e["value"] * 100).cast("long").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("scores")), entry), ";")
    return maps.select("site_id", text.alias("scores"), F.size("scores").cast("long").alias("n"))


@query(
    "top_sites",
    with_ctes(
        "site poi",
        f"""SELECT site_id, name, gu, dong, count_2000m, pct, score FROM (
        SELECT *, round_even(p*100,0)/100e0 AS pct, round_even((100-p)*100,0)/100e0 AS score FROM (
        SELECT *, (count(*) OVER () - rank() OVER (ORDER BY count_2000m) + 1 - ties + 0.5e0*ties) / count(*) OVER () * 100 AS p FROM (
        SELECT *, count(*) OVER (PARTITION BY count_2000m) AS ties FROM (
        SELECT s.site_id, s.name, s.gu, s.dong, count(d) AS count_2000m FROM site s LEFT JOIN (
        SELECT s.site_id, {sql_metres('s', 'p')} AS d FROM site s, poi p WHERE {sql_metres('s', 'p')} <= 2000) USING (site_id) GROUP BY ALL))))
        ORDER BY score DESC, gu, dong, name LIMIT 10""",
    ),
)
def top_sites(spark, d):
    """Flagship chain: distance join, count, mid-rank score, best ten."""
    sites = t.site(spark, d).select("site_id", "name", "gu", "dong", "lat", "lng")
    counts = baseline.radius_counts(sites, t.poi(spark, d), [2000])
    scored = scoring.mid_rank(counts, "count_2000m", "higher")
    top = scored.orderBy(F.desc("score"), "gu", "dong", "name").limit(10)
    return top.select("site_id", "name", "gu", "dong", "count_2000m", "pct", "score")


def _debug_sql(order, filters="", desc=False, limit=20):
    return (
        f"SELECT site_id, name, value, score, rank FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ("
        f"SELECT site_id, s.name, s.gu, s.dong, c.value, c.pct, c.score FROM site s LEFT JOIN "
        f"(SELECT * FROM scored WHERE category = 'hangang') c USING (site_id) {filters})) "
        f"ORDER BY rank {'DESC' if desc else ''} LIMIT {limit}"
    )


_DEBUG_ORDERS = {
    "score_desc": "value IS NULL, -score, value, name, gu, dong",
    "percentile_asc": "value IS NULL, pct, value, name, gu, dong",
    "raw_desc": "value IS NULL, -value, -score, name, gu, dong",
    "raw_asc": "value IS NULL, value, -score, name, gu, dong",
}


def _debug(spark, d, **options):
    rows = scores(spark, d).where("category = 'hangang'")
    return ranking.ranking_debug(rows, "lower", limit=20, **options).select("site_id", "name", "value", "score", "rank")


@query("ranking_debug", with_ctes(_BASE, _debug_sql(_DEBUG_ORDERS["score_desc"]), SCORE_CTES))
def ranking_debug(spark, d):
    return _debug(spark, d)


@query(
    "ranking_debug_bottom",
    with_ctes(_BASE, _debug_sql(_DEBUG_ORDERS["percentile_asc"], "WHERE gu = 'NATION_3'", desc=True), SCORE_CTES),
)
def ranking_debug_bottom(spark, d):
    return _debug(spark, d, sort="percentile_asc", bottom=True, gu="NATION_3")


@query(
    "ranking_debug_raw",
    with_ctes(_BASE, _debug_sql(_DEBUG_ORDERS["raw_desc"], "WHERE dong = 'BUILDING' AND contains(s.name, '00001')"), SCORE_CTES),
)
def ranking_debug_raw(spark, d):
    return _debug(spark, d, sort="raw_desc", dong="BUILDING", query="00001")


@query(
    "domain_profile",
    with_ctes(_BASE, f"SELECT site_id, domain, score, {_grade_sql('score')} AS grade FROM dom", DOMAIN_CTES),
)
def domain_profile(spark, d):
    return domains(spark, d).select("site_id", "domain", "score", "grade")


@query(
    "site_profiles",
    with_ctes(
        _BASE,
        f"""SELECT site_id, representative, {_grade_sql('representative')} AS grade, chips FROM prof JOIN (
        SELECT site_id, string_agg(domain || ' ' || grade, ',' ORDER BY rn) AS chips FROM (
        SELECT *, {_grade_sql('score')} AS grade, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, {_PLACE_CASE}) AS rn FROM dom)
        WHERE rn <= 3 GROUP BY 1) USING (site_id)""",
        DOMAIN_CTES,
    ),
)
def site_profiles(spark, d):
    found = areas.site_profiles(domains(spark, d))
    return found.select("site_id", "representative", "grade", F.array_join("chips", ",").alias("chips"))


@query(
    "area_profile",
    with_ctes(
        _BASE,
        f"SELECT level, gu, dong, site_count, scored_count, representative, {_grade_sql('representative')} AS grade FROM aprof",
        DOMAIN_CTES,
    ),
)
def area_profile(spark, d):
    return areas.area_profiles(t.site(spark, d), domains(spark, d))


@query(
    "area_domains",
    with_ctes(_BASE, f"SELECT level, gu, dong, domain, score, sample_count, {_grade_sql('score')} AS grade FROM area", DOMAIN_CTES),
)
def area_domains(spark, d):
    return areas.area_domains(domains(spark, d)).drop("rank_text")


@query(
    "city_hub",
    with_ctes(
        _BASE,
        f"""SELECT domain, score, districts, {_grade_sql('score')} AS grade FROM (
        SELECT domain, CAST(round_even(avg(score), 0) AS INT) AS score, count(*) AS districts FROM area WHERE level = 'gu' GROUP BY 1)""",
        DOMAIN_CTES,
    ),
)
def city_hub(spark, d):
    return areas.city_hub(areas.area_domains(domains(spark, d)))


@query(
    "area_topk",
    with_ctes(
        _BASE,
        """SELECT area, gu, area_dong, site_id, representative, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY area, gu, area_dong ORDER BY representative DESC, dong, name, site_id) AS rank FROM (
        SELECT 'gu' AS area, NULL AS area_dong, * FROM prof UNION ALL SELECT 'dong', dong, * FROM prof)) WHERE rank <= 8""",
        DOMAIN_CTES,
    ),
)
def area_topk(spark, d):
    found = areas.area_recommendations(areas.site_profiles(domains(spark, d)))
    return found.select("area", "gu", "area_dong", "site_id", "representative", "rank")


@query(
    "area_children",
    with_ctes(
        _BASE,
        """SELECT gu, dong, representative, rank FROM (SELECT *, row_number() OVER (PARTITION BY gu ORDER BY representative DESC, dong) AS rank
        FROM aprof WHERE level = 'dong') WHERE rank <= 12""",
        DOMAIN_CTES,
    ),
)
def area_children(spark, d):
    found = areas.child_areas(areas.area_profiles(t.site(spark, d), domains(spark, d)))
    return found.select("gu", "dong", "representative", "rank")


@query(
    "area_siblings",
    with_ctes(
        _BASE,
        "SELECT dong, representative FROM aprof WHERE level = 'dong' AND gu = 'NATION_7' AND dong <> 'MACHINERY' "
        "ORDER BY representative DESC, dong LIMIT 10",
        DOMAIN_CTES,
    ),
)
def area_siblings(spark, d):
    profiles = areas.area_profiles(t.site(spark, d), domains(spark, d))
    return areas.sibling_areas(profiles, "NATION_7", "MACHINERY").select("dong", "representative")


@query(
    "area_features",
    with_ctes(
        _BASE,
        f"""SELECT level, gu, dong, domain, score, tone FROM (SELECT *, unnest(list_filter([
        CASE WHEN b <= 3 THEN 'strong' END, CASE WHEN w = 1 AND score < 50 THEN 'caution' END], lambda x: x IS NOT NULL)) AS tone FROM (
        SELECT *, row_number() OVER (PARTITION BY level, gu, dong ORDER BY score DESC, {_PLACE_CASE}) AS b,
        row_number() OVER (PARTITION BY level, gu, dong ORDER BY score, {_PLACE_CASE}) AS w FROM area))""",
        DOMAIN_CTES,
    ),
)
def area_features(spark, d):
    found = areas.area_features(areas.area_domains(domains(spark, d)))
    return found.select("level", "gu", "dong", "domain", "score", "tone")


@query(
    "area_scopes",
    with_ctes("site", "SELECT DISTINCT gu, NULL AS dong FROM site UNION ALL SELECT DISTINCT gu, dong FROM site"),
)
def area_scopes(spark, d):
    return areas.area_scopes(t.site(spark, d))


@query(
    "compare_sites",
    with_ctes(
        _BASE,
        """SELECT category, a_score, b_score, CASE WHEN a_score > b_score THEN 'a' WHEN b_score > a_score THEN 'b' WHEN a_score = b_score THEN 'tie' END AS winner
        FROM (SELECT category, score AS a_score FROM everything WHERE site_id = 3) JOIN (SELECT category, score AS b_score FROM everything WHERE site_id = 17) USING (category)""",
        SCORE_CTES,
    ),
)
def compare_sites(spark, d):
    return ranking.compare_sites(scores(spark, d), F.col("site_id") == 3, F.col("site_id") == 17)


@query(
    "comparison_wins",
    with_ctes(
        _BASE,
        """SELECT count(*) FILTER (a.score > b.score) AS win_a, count(*) FILTER (b.score > a.score) AS win_b
        FROM scored a JOIN scored b USING (category) WHERE a.site_id = 3 AND b.site_id = 17""",
        SCORE_CTES,
    ),
)
def comparison_wins(spark, d):
    return ranking.comparison_wins(compare_sites(spark, d))


@query(
    "domain_summaries",
    with_ctes(
        _BASE,
        f"""SELECT site_id, domain, category_count, poi_count, max_score, categories FROM (
        SELECT site_id, {_DOMAIN_CASE} AS domain, count(value) AS category_count, CAST(sum(value) AS BIGINT) AS poi_count, max(score) AS max_score,
        coalesce(string_agg(category, ',' ORDER BY score DESC, category) FILTER (value IS NOT NULL), '') AS categories FROM everything GROUP BY 1, 2)""",
        SCORE_CTES,
    ),
)
def domain_summaries(spark, d):
    """Per site and domain; a category without a value is no part of it, a domain without any stays a row."""
    rows = scores(spark, d).withColumn("count", F.col("value").cast("long"))
    listed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct((-F.col("score")).alias("s"), "category"))))
    domain = F.element_at(F.create_map(*[F.lit(x) for kv in areas.CATEGORY_DOMAIN.items() for x in kv]), F.col("category"))
    return rows.groupBy("site_id", domain.alias("domain")).agg(
        F.count("value").alias("category_count"), F.sum("count").alias("poi_count"), F.max("score").alias("max_score"),
        F.array_join(F.transform(listed, lambda x: x["category"]), ",").alias("categories"),
    )


@query(
    "dynamic_score",
    with_ctes(
        "site poi",
        f"""SELECT site_id, CAST(round_even(least(sum(CASE WHEN d <= 200 THEN 1e0 WHEN d <= 500 THEN 0.7e0 WHEN d <= 1000 THEN 0.4e0 ELSE 0.15e0 END) * 12, 100), 0) AS INT) AS score
        FROM (SELECT s.site_id, {sql_metres('s', 'p')} AS d FROM site s, poi p) WHERE d <= 1500 GROUP BY 1""",
    ),
)
def dynamic_score(spark, d):
    pairs = radius.radius_join(t.site(spark, d).select("site_id", "lat", "lng"), t.poi(spark, d).select("poi_id", "lat", "lng"), 1500)
    return areas.dynamic_score(pairs)


@query(
    "subtype_chips",
    with_ctes(
        "site poi",
        f"""SELECT site_id, subtype, count(*) AS count, min(d) AS nearest_distance,
        CASE subtype WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 ELSE 9999 END AS priority
        FROM (SELECT s.site_id, p.subtype, {sql_metres('s', 'p')} AS d FROM site s, poi p) WHERE d <= 1000 GROUP BY 1, 2""",
    ),
)
def subtype_chips(spark, d):
    return areas.subtype_chips(t.site(spark, d), t.poi(spark, d), 1000, ["PROMO", "SMALL", "LARGE"])


# --- Insights: a wide table of metrics under the names the rules use --------------------------
_WIDE_SQL = """SELECT site_id, CASE WHEN site_id % 4 = 0 THEN ['9호선', '2호선'] ELSE ['2호선'] END AS subway_lines,
  subway AS transfer_count_1km, hangang AS subway_distance, CASE WHEN site_id % 3 > 0 THEN hangang * 2 END AS emergency_distance,
  cafe AS nightlife_count_500m, hospital % 2 AS general_hospital_count, bus AS bus_count, academy % 3 AS warehouse_count,
  hangang AS riverside_distance, hospital % 3 AS night_pharmacy_count, academy AS mart_count, cafe % 2 AS show_count, bus % 2 AS kids_count,
  subway % 2 AS starbucks_count, bus AS bike_count, cafe * 3 AS cafe_count, academy * 20 AS academy_count, hospital % 4 AS ev_count, cafe AS culture_count
  FROM metric"""


def insight_wide(spark, d):
    m = metrics(spark, d)
    lines = F.when(F.col("site_id") % 4 == 0, F.array(F.lit("9호선"), F.lit("2호선"))).otherwise(F.array(F.lit("2호선")))
    return m.select(
        "site_id", lines.alias("subway_lines"), F.col("subway").alias("transfer_count_1km"),
        F.col("hangang").alias("subway_distance"),
        F.when(F.col("site_id") % 3 > 0, F.col("hangang") * 2).alias("emergency_distance"),
        F.col("cafe").alias("nightlife_count_500m"), (F.col("hospital") % 2).alias("general_hospital_count"),
        F.col("bus").alias("bus_count"), (F.col("academy") % 3).alias("warehouse_count"),
        F.col("hangang").alias("riverside_distance"), (F.col("hospital") % 3).alias("night_pharmacy_count"),
        F.col("academy").alias("mart_count"), (F.col("cafe") % 2).alias("show_count"), (F.col("bus") % 2).alias("kids_count"),
        (F.col("subway") % 2).alias("starbucks_count"), F.col("bus").alias("bike_count"), (F.col("cafe") * 3).alias("cafe_count"),
        (F.col("academy") * 20).alias("academy_count"), (F.col("hospital") % 4).alias("ev_count"), F.col("cafe").alias("culture_count"),
    )


def _rule_sql(rule: str) -> str:
    return rule.replace("array_contains(", "list_contains(")


@query(
    "feature_flags",
    with_ctes(
        _BASE,
        "SELECT site_id, " + ", ".join(f"coalesce({r}, false) AS {n}" for n, r in insights.FLAGS.items()) + " FROM wide",
        {"metric": SCORE_CTES["metric"], "wide": _WIDE_SQL},
    ),
)
def feature_flags(spark, d):
    return insights.feature_flags(insight_wide(spark, d))


@query(
    "site_insights",
    with_ctes(
        _BASE,
        "SELECT site_id, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{label}' END" for _, label, _, r in insights.FEATURES)
        + """], lambda x: x IS NOT NULL)[1:6], '|') AS features, coalesce(nullif(array_to_string(list_filter([
        CASE WHEN bus_count >= 5 AND subway_distance <= 800 THEN '도보생활형' END, CASE WHEN emergency_distance <= 3000 THEN '의료안심형' END,
        CASE WHEN cafe_count >= 5 THEN '생활편의형' END, CASE WHEN show_count > 0 THEN '문화생활형' END, CASE WHEN kids_count > 0 THEN '육아형' END,
        CASE WHEN riverside_distance <= 1500 THEN '휴식형' END, CASE WHEN kids_count > 0 THEN NULL WHEN academy_count >= 50 THEN '육아형' END
        ], lambda x: x IS NOT NULL)[1:4], '|'), ''), '균형형') AS lifestyles,
        array_to_string(list_concat(CASE WHEN transfer_count_1km > 0 THEN ['transfer'] ELSE [] END, coalesce(s, []))[1:4], '|') AS strengths,
        array_to_string(list_concat(CASE WHEN nightlife_count_500m >= 10 THEN ['nightlife_dense'] ELSE [] END, coalesce(c, []))[1:4], '|') AS cautions
        FROM wide LEFT JOIN (SELECT site_id, list(category ORDER BY place, category) FILTER (pct <= 20) AS s,
        list(category ORDER BY place, category) FILTER (pct >= 85) AS c FROM (SELECT *, CASE category """
        + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(ranking.CATEGORY_ORDER))
        + """ ELSE 999 END AS place FROM scored) GROUP BY 1) USING (site_id)""",
        {**SCORE_CTES, "wide": _WIDE_SQL},
    ),
)
def site_insights(spark, d):
    found = insights.site_insights(insight_wide(spark, d), scores(spark, d))
    text = lambda c: F.array_join(c, "|").alias(c)
    features = F.array_join(F.transform("features", lambda x: x["label"]), "|").alias("features")
    return found.select("site_id", features, text("lifestyles"), text("strengths"), text("cautions"))


@query(
    "score_highlights",
    with_ctes(
        _BASE,
        """SELECT site_id, category, rank, CASE WHEN score >= 60 THEN '우수' ELSE '상대 강점' END AS suffix FROM (
        SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, category) AS rank FROM scored) WHERE rank <= 3""",
        SCORE_CTES,
    ),
)
def score_highlights(spark, d):
    return insights.score_highlights(scores(spark, d)).select("site_id", "category", "rank", "suffix")


@query(
    "score_fallback",
    with_ctes(
        _BASE,
        """SELECT site_id, category, CAST(CASE WHEN p IS NOT NULL THEN round_even(greatest(0, least(100, 100 - p)), 0)
        WHEN k = 'school-environment' THEN CASE WHEN dist IS NULL THEN 10 WHEN dist <= 150 THEN 95 WHEN dist <= 300 THEN 88 WHEN dist <= 500 THEN 78
        WHEN dist <= 800 THEN 62 WHEN dist <= 1200 THEN 45 WHEN dist <= 1500 THEN 30 ELSE 15 END
        WHEN raw BETWEEN 0 AND 100 THEN round_even(raw, 0)
        ELSE CASE WHEN n >= 10 THEN 90 WHEN n >= 5 THEN 75 WHEN n >= 3 THEN 55 WHEN n >= 1 THEN 35 ELSE 10 END END AS INT) AS shown FROM (
        SELECT site_id, category, CASE WHEN site_id % 4 = 0 THEN pct END AS p, CASE WHEN site_id % 4 = 1 THEN 'school-environment' ELSE category END AS k,
        value * 3 AS dist, CASE WHEN site_id % 4 = 2 THEN score + 0.5e0 END AS raw, value AS n FROM everything)""",
        SCORE_CTES,
    ),
)
def score_fallback(spark, d):
    """The fallback chain: percentile, school rule, raw score, count, each for a quarter of the sites."""
    turn = F.col("site_id") % 4
    rows = scores(spark, d).select(
        "site_id", "category", F.when(turn == 0, F.col("pct")).alias("p"), F.lit(None).cast("double").alias("own"),
        F.when(turn == 1, "school-environment").otherwise(F.col("category")).alias("k"), (F.col("value") * 3).alias("dist"),
        F.when(turn == 2, F.col("score") + 0.5).alias("raw"), F.col("value").alias("n"),
    )
    return rows.select("site_id", "category", summary_score("p", "own", "k", "dist", "raw", "n").alias("shown"))


@query(
    "category_order",
    with_ctes(
        _BASE,
        "SELECT site_id, string_agg(category, ',' ORDER BY CASE category "
        + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(ranking.CATEGORY_ORDER))
        + " ELSE 99 END) AS shown FROM everything GROUP BY 1",
        SCORE_CTES,
    ),
)
def category_order(spark, d):
    rows = scores(spark, d)
    listed = F.array_sort(F.collect_list(F.struct(ranking.display_position("category").alias("p"), "category")))
    return rows.groupBy("site_id").agg(
        F.array_join(F.transform(listed, lambda x: x["category"]), ",").alias("shown")
    )
