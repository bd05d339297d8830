"""Queries on cleaning, normalising, classifying and displaying.

Words that the rules look for are put on the given rows by key: row k carries the k-th phrase.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import display, rules, text as tx
from ..functions.geo import PROJECTIONS, half_even, has_coordinates, in_bounds, projected_to_wgs84, projection_steps
from ..operators import stations
from . import tables as t
from .registry import query

PHRASES = [
    "서울 밝은치과", "한마음 한의원", "연세 안과의원", "튼튼 정형외과", "소아청소년과 의원", "우리내과", "중앙외과",
    "강남 종합병원", "24시 약국", "이마트트레이더스 양재점", "코스트코 상봉점", "이마트에브리데이 신림", "홈플러스 익스프레스",
    "이마트 성수점", "emart24 역삼", "CU 서초점", "GS25 방배", "스타벅스 강남", "MEGA MGC 커피", "Paul Bassett 광화문",
    "영어 회화 학원", "sat 준비반", "피아노 교습소", "수학 전문", "보습 학원", "컴퓨터 코딩", "독서실", "hsk 중국어",
    "뮤지컬 공연", "미술관 관람", "테니스장", "키즈 놀이터", "도시농업 체험", "요가 강좌", "둘레길 산책", "민원 회의실",
    "룸살롱", "간이주점", "나이트클럽", "119안전센터", "구조대", "생활방범", "어린이보호구역", "교통단속", "시설관리",
    "축구장", "자전거대여", "물놀이장", "화장실", "나들목", "매점과 분수 광장", "현대백화점", "복합쇼핑몰", "남대문시장", "전문점",
]
NAMES = [
    "래미안(101동)아파트", "Ｈｙｕｎｄａｉ ２차", "삼성Ⅱ차 apt", "nan", "  ", "힐스테이트[주상복합]", "자이 3단지", "e편한세상-신촌",
    "주공03단지", "㈜우방 아파트",
]
ADDRESSES = [
    "서울특별시 강남구 테헤란로 12", "서울시 종로구 평동 (경희궁)", "강서구  마곡동 77-3", "-", "null", "서울 마포구 신문로2가 1-4",
]
LOTS = ["12-3", "0045-0000", "산 7", "-", "8", "12-03", "abc", ""]
MONEY = ["12,500", "9,800만원", " 1 200 ", "-", "nan", "100.5", "101.5", "x", "0"]
DATES = ["20240105", "2024-01-05 00:00:00", "202402", "2014.09", "20140926.0", "", "2023-13-01", "1999"]
ROUTES = ["N26", "M7106", "G6000", "마포01", "6001", "9401", "7211", "143", "99", "0411", "a12", ""]
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0)", "Googlebot/2.1", "curl/8.0", "", "Mozilla/5.0 NAVER(inapp)", "Yeti/1.1", "python-requests/2.31",
]
HOURS = ["2200", "0900", "2359", "1800", "24", "", "abcd", "2430"]
LIMITS = ["Y", "N", "입주민 전용", "없음", "", "회원"]


def pick(options: list[str], key: str, step: int = 1) -> Column:
    """The phrase a row carries, chosen by its key."""
    return F.element_at(
        F.array(*[F.lit(o) for o in options]), (F.floor(F.col(key) / step) % len(options) + 1).cast("int")
    )


def sql_pick(options: list[str], key: str, step: int = 1) -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"[{listed}][CAST({key} // {step} % {len(options)} AS INT) + 1]"


def sql_any(value: str, words, fold: bool = False) -> str:
    value = f"lower({value})" if fold else value
    return "(" + " OR ".join(f"contains({value}, '{w.lower() if fold else w}')" for w in words) + ")"


def sql_first(value: str, table, default: str | None, fold: bool = False) -> str:
    cases = " ".join(f"WHEN {sql_any(value, words, fold)} THEN '{label}'" for label, words in table)
    return f"CASE {cases} ELSE {'NULL' if default is None else repr(default)} END"


def sql_all(value: str, table) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_any(value, w)} THEN '{n}' END" for n, w in table) + "], lambda x: x IS NOT NULL)"


def sql_clean(value: str) -> str:
    return f"CASE WHEN trim({value}) = '' OR lower(trim({value})) IN ('nan', 'none', 'null') THEN NULL ELSE trim({value}) END"


def labelled(spark, d):
    return t.read(spark, d, "part").select("p_partkey", pick(PHRASES, "p_partkey").alias("label"))


_LABELLED = f"(SELECT p_partkey, {sql_pick(PHRASES, 'p_partkey')} AS label FROM part)"


@query(
    "classify_facilities",
    f"""SELECT p_partkey, {sql_first('label', rules.HOSPITAL_SPECIALTIES, '기타')} AS specialty,
    {sql_first('label', rules.ACADEMY_RULES, '기타', True)} AS academy, {sql_first('label', rules.NIGHTLIFE_RULES, '기타')} AS nightlife,
    {sql_first('label', rules.FIRE_RULES, '기타')} AS fire, {sql_first('label', rules.SCHOOL_RULES, 'etc')} AS school,
    {sql_first('label', rules.CAMERA_RULES, '기타')} AS camera, {sql_any('label', ['상급종합병원', '종합병원'])} AS superior
    FROM {_LABELLED}""",
)
def classify_facilities(spark, d):
    none = F.lit(None).cast("string")
    return labelled(spark, d).select(
        "p_partkey", rules.hospital_specialty("label", none).alias("specialty"), rules.academy_type("label").alias("academy"),
        rules.nightlife_type("label").alias("nightlife"), rules.first_match("label", rules.FIRE_RULES, "기타").alias("fire"),
        rules.first_match("label", rules.SCHOOL_RULES, "etc").alias("school"),
        rules.first_match("label", rules.CAMERA_RULES, "기타").alias("camera"),
        rules.is_superior_hospital("label", none).alias("superior"),
    )


_CULTURE_SQL = "CASE " + " ".join(
    f"WHEN {sql_any('whole', words)}" + (f" OR top = '{rules.CULTURE_TOP[n]}'" if n in rules.CULTURE_TOP else "") + f" THEN '{n}'"
    for n, words in rules.CULTURE_RULES
) + " ELSE '기타' END"
_TOPS, _STATES = ["문화체험", "체육시설", "교육강좌", "기타분류"], ["접수중", "안내중", "종료"]


@query(
    "classify_culture",
    f"""SELECT p_partkey, {_CULTURE_SQL} AS kind, status IN ('접수중', '안내중') AND top IN ('문화체험', '체육시설', '교육강좌')
    AND NOT {sql_any('whole', rules.CULTURE_EXCLUDED)} AS kept FROM (
    SELECT p_partkey, top, status, top || ' ' || label AS whole FROM (
    SELECT *, {sql_pick(_TOPS, 'p_partkey', 3)} AS top, {sql_pick(_STATES, 'p_partkey', 5)} AS status FROM {_LABELLED}))""",
)
def classify_culture(spark, d):
    rows = labelled(spark, d).withColumns(
        {"top": pick(_TOPS, "p_partkey", 3), "status": pick(_STATES, "p_partkey", 5), "none": F.lit(None).cast("string")}
    )
    return rows.select(
        "p_partkey", rules.culture_type("top", "none", "label", "none").alias("kind"),
        rules.culture_kept("status", "top", "none", "label", "none").alias("kept"),
    )


_KINDS = ["백화점", "대형마트", "쇼핑센터", "그 밖의 대규모점포", "전문점", ""]


@query(
    "classify_shops",
    f"""SELECT p_partkey, CASE WHEN contains(kind || ' ' || label, '백화점') THEN '백화점'
    WHEN contains(kind, '복합') OR contains(kind || ' ' || label, '쇼핑몰') OR contains(label, '몰') THEN '쇼핑몰'
    WHEN contains(kind || ' ' || label, '쇼핑센터') THEN '쇼핑몰' WHEN contains(kind || ' ' || label, '시장') THEN '시장'
    WHEN contains(kind, '전문점') THEN '전문점' ELSE '기타쇼핑' END AS shop,
    kind = '대형마트' OR {sql_any('label', rules.MART_LIKE, True)} AS mart_like,
    CASE area WHEN '골목상권' THEN '골목' WHEN '발달상권' THEN '대형상권' WHEN '전통시장' THEN '시장' WHEN '관광특구' THEN '관광특구' WHEN '' THEN '기타' ELSE area END AS area,
    state = '영업/정상' AS open_plain, contains(state, '영업/정상') AND contains(detail, '정상영업') AS open_strict FROM (
    SELECT p_partkey, label, {sql_pick(_KINDS, 'p_partkey', 2)} AS kind, {sql_pick(['골목상권', '발달상권', '전통시장', '관광특구', '', '새상권'], 'p_partkey')} AS area,
    {sql_pick(['영업/정상', '폐업', '(영업/정상)'], 'p_partkey')} AS state, {sql_pick(['정상영업', '폐업처리'], 'p_partkey', 3)} AS detail FROM {_LABELLED})""",
)
def classify_shops(spark, d):
    rows = labelled(spark, d).withColumns(
        {
            "kind": pick(_KINDS, "p_partkey", 2),
            "area": pick(["골목상권", "발달상권", "전통시장", "관광특구", "", "새상권"], "p_partkey"),
            "state": pick(["영업/정상", "폐업", "(영업/정상)"], "p_partkey"),
            "detail": pick(["정상영업", "폐업처리"], "p_partkey", 3),
        }
    )
    return rows.select(
        "p_partkey", rules.shopping_type("kind", "label").alias("shop"), rules.is_mart_like("kind", "label").alias("mart_like"),
        rules.commercial_type("area").alias("area"), rules.open_business("state").alias("open_plain"),
        rules.open_business("state", "detail").alias("open_strict"),
    )


_MART_GROUP_SQL = "CASE " + " ".join(
    "WHEN mart IN (" + ", ".join(f"'{b}'" for b in brands) + f") THEN '{g}'" for g, (_, brands) in rules.MART_GROUPS.items()
) + " END"


@query(
    "classify_brands",
    f"SELECT *, {_MART_GROUP_SQL} AS mart_group FROM (SELECT p_partkey, "
    + ", ".join(f"{sql_first('label', table, None, True)} AS {name}" for name, table in rules.BRAND_RULES.items())
    + f" FROM {_LABELLED})",
)
def classify_brands(spark, d):
    rows = labelled(spark, d).select("p_partkey", *[rules.brand(name, "label").alias(name) for name in rules.BRAND_RULES])
    return rows.withColumn("mart_group", rules.mart_group("mart"))


@query(
    "classify_riverside",
    f"""SELECT p_partkey, {sql_first('label', rules.FACILITY_GROUPS, '기타')} AS facility_group,
    array_to_string({sql_all('label', rules.FACILITY_TAGS)}[1:4], '|') AS tags FROM {_LABELLED}""",
)
def classify_riverside(spark, d):
    tags = F.slice(rules.all_matches("label", rules.FACILITY_TAGS), 1, rules.FACILITY_TAGS_SHOWN)
    return labelled(spark, d).select(
        "p_partkey", rules.facility_group("label").alias("facility_group"), F.array_join(tags, "|").alias("tags")
    )


_BUS_SQL = """CASE WHEN regexp_matches(r, '^N') THEN 'night' WHEN regexp_matches(r, '^[MG]') THEN 'express'
  WHEN regexp_matches(r, '[가-힣]') THEN 'village' WHEN NOT regexp_matches(r, '^[0-9]+$') THEN 'unknown'
  WHEN r[1] = '6' THEN 'airport' WHEN length(r) = 4 AND r[1] = '9' THEN 'express' WHEN length(r) = 4 THEN 'local'
  WHEN length(r) = 3 THEN 'main' WHEN r[1] = '9' THEN 'express' ELSE 'unknown' END"""
_LABEL_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.BUS_LABELS.items()) + " END"
_ORDER_SQL = "CASE label " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(rules.BUS_LABEL_ORDER)) + " END"


@query(
    "classify_bus_routes",
    f"""SELECT l_suppkey, count(DISTINCT route) AS routes,
    array_to_string(list_filter([{", ".join(repr(x) for x in rules.BUS_LABEL_ORDER)}], lambda x: list_contains(list(label), x)), '|') AS types,
    first(label ORDER BY {_ORDER_SQL}) AS primary_type FROM (SELECT *, {_LABEL_SQL} AS label FROM (
    SELECT *, {_BUS_SQL} AS kind FROM (SELECT l_suppkey, route, upper(trim(route)) AS r FROM (
    SELECT l_suppkey, {sql_pick(ROUTES, 'turn')} AS route FROM (SELECT l_suppkey, l_partkey // 21 * 3 + l_suppkey % 3 AS turn FROM lineitem)))))
    GROUP BY 1""",
)
def classify_bus_routes(spark, d):
    """Stops serve a third of the routes, by their number; types in priority order."""
    rows = t.read(spark, d, "lineitem").withColumn("turn", F.floor(F.col("l_partkey") / 21) * 3 + F.col("l_suppkey") % 3)
    routes = rows.select("l_suppkey", pick(ROUTES, "turn").alias("route")).groupBy("l_suppkey").agg(
        F.collect_set("route").alias("r")
    )
    return routes.select(
        "l_suppkey", F.size("r").cast("long").alias("routes"), F.array_join(rules.stop_types("r"), "|").alias("types"),
        rules.primary_stop_type("r").alias("primary_type"),
    )


_MINUTES = (
    "CASE WHEN regexp_matches({c}, '^[0-9]+$') AND CAST({c} AS INT) // 100 <= 24 AND CAST({c} AS INT) % 100 < 60 "
    "THEN CAST({c} AS INT) // 100 * 60 + CAST({c} AS INT) % 100 END"
)


def _hours(key: str, k: int) -> Column:
    return pick(HOURS, key, 3**k)


@query(
    "pharmacy_hours",
    "SELECT p_partkey, CASE WHEN len(l) = 0 THEN '일반' ELSE array_to_string(l, '|') END AS types, grid FROM (SELECT p_partkey, list_filter(["
    + "CASE WHEN " + " OR ".join(f"coalesce({_MINUTES.format(c=f'c{k}')} >= 1320, false)" for k in range(8)) + " THEN '야간' END, "
    + "CASE WHEN (c5 <> '' AND c4 <> '') OR (c6 <> '' AND c5 <> '') THEN '주말' END, CASE WHEN c7 <> '' AND c6 <> '' THEN '휴일' END], lambda x: x IS NOT NULL) AS l, "
    + "CASE WHEN " + " OR ".join(f"regexp_matches(c{k}, '^(2[2-9]|[3-9][0-9]).')" for k in range(5)) + " THEN '야간(22시 이후)' ELSE '일반' END AS grid "
    + "FROM (SELECT p_partkey, " + ", ".join(f"{sql_pick(HOURS, 'p_partkey', 3**k)} AS c{k}" for k in range(8)) + " FROM part))",
)
def pharmacy_hours(spark, d):
    rows = t.read(spark, d, "part").select("p_partkey", *[_hours("p_partkey", k).alias(f"c{k}") for k in range(8)])
    closes = [f"c{k}" for k in range(8)]
    opens = ["c0", *closes[:-1]]
    return rows.select(
        "p_partkey", F.array_join(rules.pharmacy_types(opens, closes), "|").alias("types"),
        rules.grid_pharmacy_type(closes[:5]).alias("grid"),
    )


_FIELDS = ["입시.검정 및 보습", "독서실", "국제화", "예능(대)", "직업기술", "종합(대)"]
_CLASSES = ["종합병원", "치과병원", "한방병원", "요양병원", "의원", "상급종합"]


@query(
    "grid_layer_subtypes",
    f"""SELECT p_partkey, CASE WHEN {sql_any('f', ['입시', '보습'])} THEN '입시·보습' WHEN contains(f, '독서실') THEN '독서·논술'
    WHEN contains(f, '국제화') OR contains(s, '외국어') THEN '외국어' WHEN contains(f, '예능') THEN '예체능' WHEN {sql_any('f', ['기예', '직업', '기술'])} THEN '직업·기술' ELSE '기타' END AS academy,
    CASE WHEN c IN ('종합병원', '상급종합') THEN '종합병원' WHEN contains(c, '치과') THEN '치과' WHEN {sql_any('c', ['한의', '한방'])} THEN '한의원'
    WHEN c IN ('병원', '요양병원') THEN '병원' ELSE '의원' END AS hospital,
    CASE WHEN (p_size % 3 > 0 AND p_size % 4 = 0) OR contains(u, '입주민') THEN '이용제한' WHEN p_size % 5 > 0 THEN '급속(개방)' ELSE '완속(개방)' END AS charger FROM (
    SELECT p_partkey, p_size, {sql_pick(_FIELDS, 'p_partkey')} AS f, {sql_pick(['외국어(대)', '보통'], 'p_partkey', 6)} AS s,
    {sql_pick(_CLASSES, 'p_partkey')} AS c, {sql_pick(['24시간', '입주민만', ''], 'p_partkey', 2)} AS u FROM part)""",
)
def grid_layer_subtypes(spark, d):
    rows = t.read(spark, d, "part").select(
        "p_partkey", "p_size", pick(_FIELDS, "p_partkey").alias("f"), pick(["외국어(대)", "보통"], "p_partkey", 6).alias("s"),
        pick(_CLASSES, "p_partkey").alias("c"), pick(["24시간", "입주민만", ""], "p_partkey", 2).alias("u"),
        F.expr("p_size % 3").alias("r"), F.expr("p_size % 4").alias("o"), F.expr("p_size % 5").alias("q"),
    )
    return rows.select(
        "p_partkey", rules.grid_academy_type("f", "s").alias("academy"), rules.grid_hospital_type("c").alias("hospital"),
        rules.grid_charger_type("r", "o", "q", "u").alias("charger"),
    )


@query(
    "bot_agents",
    f"""SELECT agent, a = '' OR regexp_matches(a, '{rules.BOT_PATTERN}') AS bot, count(*) AS n
    FROM (SELECT {sql_pick(AGENTS, 'event_id')} AS agent, {sql_pick(AGENTS, 'event_id')} AS a FROM events) GROUP BY 1, 2""",
)
def bot_agents(spark, d):
    rows = t.read(spark, d, "events").select(pick(AGENTS, "event_id").alias("agent"))
    return rows.groupBy("agent", rules.is_bot("agent").alias("bot")).agg(F.count("*").alias("n"))


def _bucket_sql(value, buckets):
    def test(low, high):
        parts = ([f"{value} >= {low}"] if low is not None else []) + ([f"{value} < {high}"] if high is not None else [])
        return " AND ".join(parts)

    return "CASE " + " ".join(f"WHEN {test(low, high)} THEN '{k}'" for k, low, high in buckets) + " END"


def _bands_sql(value, bands, default):
    return "CASE " + " ".join(f"WHEN {value} >= {n} THEN '{x}'" for n, x in bands) + f" ELSE '{default}' END"


@query(
    "buckets_and_grades",
    f"""SELECT o_orderkey, {_bucket_sql('v', rules.HOUSEHOLD_BUCKETS)} AS household, {_bucket_sql('p', rules.TRADE_BUCKETS)} AS trade,
    {_bucket_sql('p', rules.JEONSE_BUCKETS)} AS jeonse, {_bands_sql('s', rules.DOMAIN_GRADES, 'D')} AS domain_grade,
    {_bands_sql('s', rules.CATEGORY_GRADES, 'D')} AS category_grade, {_bands_sql('s', rules.SCORE_CLASSES, 'score-low')} AS score_class,
    CASE WHEN s <= 20 THEN 'score-good' WHEN s >= 80 THEN 'score-low' ELSE 'score-normal' END AS percentile_class,
    CASE WHEN s <= 5 THEN '서울시 최상위권입니다' WHEN s <= 20 THEN '서울시 기준 우수한 편입니다' WHEN s <= 60 THEN '서울시 평균 수준입니다'
    WHEN s <= 80 THEN '서울시 평균보다 다소 낮은 편입니다' ELSE '서울시 기준 부족한 편입니다' END AS words,
    CASE WHEN s < 1 THEN '서울 상위 1% 이내' ELSE '서울 상위 ' || CAST(floor(s) AS INT) || '%' END AS label
    FROM (SELECT o_orderkey, o_orderkey * 7 % 2500 AS v, o_totalprice AS p, (o_orderkey * 13 % 1001) / 10e0 AS s FROM orders)""",
)
def buckets_and_grades(spark, d):
    rows = t.read(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderkey * 7 % 2500 AS v", "o_totalprice AS p", "(o_orderkey * 13 % 1001) / 10D AS s"
    )
    return rows.select(
        "o_orderkey", rules.bucket_of("v", rules.HOUSEHOLD_BUCKETS).alias("household"),
        rules.bucket_of("p", rules.TRADE_BUCKETS).alias("trade"), rules.bucket_of("p", rules.JEONSE_BUCKETS).alias("jeonse"),
        rules.domain_grade("s").alias("domain_grade"), rules.category_grade("s").alias("category_grade"),
        rules.score_class("s").alias("score_class"), rules.percentile_class("s").alias("percentile_class"),
        rules.percentile_words("s").alias("words"), rules.percentile_label("s").alias("label"),
    )


_ROMAN = {"Ⅱ": "ii"}
_FULL = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)).replace("'", "''")


def _compat_sql(value: str) -> str:
    return f"lower(replace(translate({sql_clean(value)}, '{_FULL}', '{_PLAIN}'), 'Ⅱ', 'ii'))"


def _name_sql(value: str) -> str:
    no_brackets = f"regexp_replace(regexp_replace({_compat_sql(value)}, '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g')"
    return f"coalesce(regexp_replace(regexp_replace({no_brackets}, '(아파트|apt)$', ''), '[^0-9a-z가-힣]', '', 'g'), '')"


def _address_sql(value: str) -> str:
    inner = f"regexp_replace(regexp_replace({_compat_sql(value)}, '\\([^)]*\\)', '', 'g'), '^(서울특별시|서울시)', '')"
    return f"coalesce(regexp_replace({inner}, '[^0-9a-z가-힣]', '', 'g'), '')"


@query(
    "normalise_names",
    f"""SELECT c_custkey, {_name_sql('n')} AS name_norm, {_address_sql('a')} AS address_norm,
    lower(replace(coalesce({sql_clean('n')}, ''), ' ', '')) AS search_text,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_name_sql('n')}, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')))), '|') AS numbers,
    contains(n, '임대') OR c_custkey % 11 = 0 AS rental FROM (
    SELECT c_custkey, {sql_pick(NAMES, 'c_custkey')} || CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 NOT IN (3, 4) THEN ' ' || c_name ELSE '' END AS n,
    {sql_pick(ADDRESSES, 'c_custkey')} AS a FROM customer)""",
)
def normalise_names(spark, d):
    key = F.col("c_custkey")
    extra = F.when((key % 2 == 0) & ~(key % 10).isin(3, 4), F.concat(F.lit(" "), F.col("c_name"))).otherwise(F.lit(""))
    rows = t.read(spark, d, "customer").select(
        "c_custkey", F.concat(pick(NAMES, "c_custkey"), extra).alias("n"), pick(ADDRESSES, "c_custkey").alias("a")
    )
    norm = tx.normalize_name("n")
    tenure = F.when(F.col("c_custkey") % 11 == 0, F.lit("임대"))
    return rows.select(
        "c_custkey", norm.alias("name_norm"), tx.normalize_address("a").alias("address_norm"),
        tx.normalize_search("n").alias("search_text"), F.array_join(tx.number_tokens(norm), "|").alias("numbers"),
        tx.is_rental(tenure, "n").alias("rental"),
    )


@query(
    "address_parts",
    f"""SELECT c_custkey, list_filter(w, lambda x: ends_with(x, '구'))[1] AS gu, list_filter(w, lambda x: ends_with(x, '동') OR ends_with(x, '가'))[1] AS dong,
    w[1] AS sido, w[2] AS second, CASE WHEN len(w) >= 3 THEN array_to_string(w[3:], ' ') END AS rest,
    CASE WHEN a IS NULL OR a = '-' THEN NULL WHEN contains(a, ' ') AND regexp_matches(a, '^(서울특별시|서울시)') THEN a ELSE '서울특별시 중구 ' || a END AS road FROM (
    SELECT c_custkey, a, string_split(regexp_replace(a, '\\s+', ' ', 'g'), ' ') AS w FROM (
    SELECT c_custkey, {sql_clean(sql_pick(ADDRESSES, 'c_custkey'))} AS a FROM customer))""",
)
def address_parts(spark, d):
    rows = t.read(spark, d, "customer").select("c_custkey", pick(ADDRESSES, "c_custkey").alias("a"))
    gu, dong = tx.address_tokens("a")
    sido, second, rest = tx.split_region("a")
    return rows.select(
        "c_custkey", gu.alias("gu"), dong.alias("dong"), sido.alias("sido"), second.alias("second"), rest.alias("rest"),
        tx.road_address(F.lit("서울특별시"), F.lit("중구"), "a").alias("road"),
    )


def _lot_part_sql(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN {value} IS NULL OR {value} = '-' THEN NULL WHEN {digits} <> '' THEN regexp_replace({digits}, '^0+([0-9])', '\\1') ELSE {value} END"
    )


@query(
    "lot_numbers",
    f"""SELECT p_partkey, {_lot_part_sql('l')} AS part, CASE WHEN ok THEN {_lot_part_sql('m')} END AS bonbun,
    CASE WHEN ok AND {_lot_part_sql('s')} <> '0' THEN {_lot_part_sql('s')} END AS bubun,
    CASE WHEN {_lot_part_sql('l')} IS NOT NULL THEN {_lot_part_sql('l')} || CASE WHEN p_size % 3 > 0 THEN '-' || (p_size % 3) ELSE '' END END AS composed
    FROM (SELECT *, regexp_matches(l, '^[0-9]+(-[0-9]+)?$') AS ok, string_split(l, '-')[1] AS m, string_split(l, '-')[2] AS s FROM (
    SELECT p_partkey, p_size, {sql_clean(sql_pick(LOTS, 'p_partkey'))} AS l FROM part))""",
)
def lot_numbers(spark, d):
    rows = t.read(spark, d, "part").select(
        "p_partkey", pick(LOTS, "p_partkey").alias("l"), (F.col("p_size") % 3).cast("string").alias("sub")
    )
    main, sub = tx.split_lot("l")
    return rows.select(
        "p_partkey", tx.lot_part("l").alias("part"), main.alias("bonbun"), sub.alias("bubun"),
        tx.compose_lot("l", "sub").alias("composed"),
    )


_DIGITS = "regexp_replace(d, '[^0-9]', '', 'g')"
_MADE_SQL = (
    f"CASE WHEN length({_DIGITS}) >= 8 THEN try_strptime(substr({_DIGITS}, 1, 8), '%Y%m%d') "
    f"WHEN length({_DIGITS}) = 6 THEN try_strptime({_DIGITS} || '01', '%Y%m%d') END"
)


@query(
    "money_and_dates",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    CAST(round_even(TRY_CAST(regexp_replace(m, '[, ]|만원', '', 'g') AS DOUBLE), 0) AS BIGINT) AS amount,
    TRY_CAST(replace(m, ',', '') AS DOUBLE) AS number,
    CAST({_MADE_SQL} AS DATE) AS made, CASE WHEN contains(d, '-') THEN array_to_string(string_split(string_split(d, ' ')[1], '-')[1:2], '.')
    WHEN regexp_matches(regexp_replace(d, '\\.0$', ''), '^[0-9]{{6,}}$') THEN substr(d, 1, 4) || '.' || substr(d, 5, 2) ELSE regexp_replace(d, '\\.0$', '') END AS year_month
    FROM (SELECT *, {sql_clean(sql_pick(MONEY, 'l_partkey'))} AS m, {sql_clean(sql_pick(DATES, 'l_partkey'))} AS d FROM lineitem)""",
)
def money_and_dates(spark, d):
    rows = t.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        pick(MONEY, "l_partkey").alias("m"), pick(DATES, "l_partkey").alias("d"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", tx.money("m").alias("amount"),
        tx.number("m").alias("number"), tx.deal_date("d").alias("made"), tx.year_month("d").alias("year_month"),
    )


@query(
    "tags_and_lists",
    """SELECT user_id, array_to_string(list_distinct_ordered, ' · ') AS tags, array_to_string(list_distinct_ordered[1:3], '|') AS first_three FROM (
    SELECT user_id, list_filter(list_distinct_keep, lambda x: x <> '') AS list_distinct_ordered FROM (
    SELECT user_id, list_filter(w, lambda x, k: list_position(w, x) = k) AS list_distinct_keep FROM (
    SELECT user_id, [event_type_a, event_type_b, event_type_a, 'x', ''] AS w FROM (
    SELECT user_id, min(event_type) AS event_type_a, max(event_type) AS event_type_b FROM events GROUP BY 1))))""",
)
def tags_and_lists(spark, d):
    rows = t.read(spark, d, "events").groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    text = F.concat(F.col("a"), F.lit(" / "), F.col("b"), F.lit(","), F.col("a"), F.lit("·x· "))
    names = F.array("a", "b", "a", F.lit("x"), F.lit(" "))
    return rows.select("user_id", tx.tag_text(text).alias("tags"), F.array_join(tx.name_list(names, 3), "|").alias("first_three"))


def _money_text_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN '' WHEN round_even({value}, 0) >= 10000 THEN format('{{:.1f}}억', round_even(round_even({value}, 0) / 10000e0 * 10, 0) / 10e0) "
        f"ELSE format('{{:,}}만원', CAST(round_even({value}, 0) AS BIGINT)) END"
    )


@query(
    "display_texts",
    f"""SELECT o_orderkey, {_money_text_sql('a')} AS money, CASE WHEN m > 0 THEN '보증금 ' || {_money_text_sql('a')} || ' / ' || format('{{:,}}만원', m) ELSE {_money_text_sql('a')} END AS rent,
    format('{{:,}}', o_orderkey) AS count_text, format('{{:,}}m', o_custkey) AS distance, strftime(o_orderdate, '%Y.%m.%d') AS day,
    (o_orderkey % 40) || '층' AS floor, CAST(round_even(20 + o_orderkey % 300 / 2e0, 0) AS INT) || '㎡' AS area,
    format('{{:.1f}}%', round_even((o_orderkey % 1000) / 8e0 * 10, 0) / 10e0) AS percent FROM (
    SELECT *, o_totalprice / 10 AS a, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS m FROM orders)""",
)
def display_texts(spark, d):
    rows = t.read(spark, d, "orders").withColumns(
        {"a": F.col("o_totalprice") / 10, "m": F.expr("CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END")}
    )
    return rows.select(
        "o_orderkey", display.money_text("a").alias("money"), display.rent_text("a", "m").alias("rent"),
        display.count_text("o_orderkey").alias("count_text"), display.distance_text("o_custkey").alias("distance"),
        display.date_text("o_orderdate").alias("day"), display.floor_text(F.col("o_orderkey") % 40).alias("floor"),
        display.area_label(F.expr("20 + o_orderkey % 300 / 2D")).alias("area"),
        display.percent_text(F.expr("o_orderkey % 1000 / 8D")).alias("percent"),
    )


@query(
    "combo_keys",
    """SELECT event_id, concat_ws(';', CASE WHEN event_id % 5 <> 3 THEN 'bus=' || (event_id % 5) END, CASE WHEN user_id % 4 <> 3 THEN 'cafe=' || (user_id % 4) END) AS weights,
    CASE WHEN event_id % 2 = 0 THEN 'area=60_85,u60;' ELSE '' END || 'gu=' || event_type AS filters,
    substr(sha256((user_id || '.0.0.1') || '|' || event_type || '|seed|' || strftime(ts, '%Y-%m-%d')), 1, 16) AS visitor,
    CAST(ts + INTERVAL 9 HOUR AS DATE) AS local_day FROM events""",
)
def combo_keys(spark, d):
    """Weight and filter combinations of clicks; weights at the default leave no pair."""
    rows = t.read(spark, d, "events")
    weights = F.create_map(
        F.lit("cafe"), (F.col("user_id") % 4).cast("int"), F.lit("bus"), (F.col("event_id") % 5).cast("int"), F.lit("park"), F.lit(3)
    )
    area = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("u60"), F.lit("60_85"))).otherwise(F.array().cast("array<string>"))
    filters = F.create_map(F.lit("gu"), F.array("event_type"), F.lit("area"), area, F.lit("dong"), F.array(F.lit("")))
    ip = F.concat(F.col("user_id").cast("string"), F.lit(".0.0.1"))
    day = F.col("ts").cast("date")
    return rows.select(
        "event_id", display.weight_combo(weights).alias("weights"), display.filter_combo(filters).alias("filters"),
        display.visitor_hash(ip, "event_type", day, "seed").alias("visitor"),
        (F.col("ts") + F.expr("INTERVAL 9 HOURS")).cast("date").alias("local_day"),
    )


@query(
    "share_round_trip",
    "SELECT c_custkey, c_name AS name, c_mktsegment AS dong, false AS padded FROM customer",
)
def share_round_trip(spark, d):
    """Filters of every customer encoded for a link and decoded again."""
    rows = t.read(spark, d, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("dong")).alias("f")
    )
    token = display.encode_share("f")
    back = rows.select("c_custkey", token.alias("token")).withColumn(
        "f", display.decode_share("token", "name string, dong string")
    )
    return back.select("c_custkey", "f.name", "f.dong", F.col("token").rlike("[=+/]").alias("padded"))


@query(
    "typed_cells",
    f"""SELECT p_partkey, {sql_clean('v')} AS cleaned, TRY_CAST({sql_clean('v')} AS DOUBLE) AS value FROM (
    SELECT p_partkey, {sql_pick(['nan', ' 12.5 ', 'None', '', '7', '-3', 'text', 'NULL'], 'p_partkey')} AS v FROM part)""",
)
def typed_cells(spark, d):
    rows = t.read(spark, d, "part").select(
        "p_partkey", pick(["nan", " 12.5 ", "None", "", "7", "-3", "text", "NULL"], "p_partkey").alias("v")
    )
    return rows.select("p_partkey", tx.clean("v").alias("cleaned"), tx.number("v").alias("value"))


@query(
    "bounds_filter",
    """SELECT poi_id, lat BETWEEN 37.47e0 AND 37.62e0 AND lng BETWEEN 126.82e0 AND 127.05e0 AS in_box,
    lat BETWEEN 37.47e0 - 0.035e0 AND 37.62e0 + 0.035e0 AND lng BETWEEN 126.82e0 - 0.035e0 AND 127.05e0 + 0.035e0 AS in_margin,
    poi_id % 50 > 0 AS placed FROM (""" + t.CTES["poi"] + ")",
)
def bounds_filter(spark, d):
    box = (37.47, 37.62, 126.82, 127.05)
    lat0 = F.when(F.col("poi_id") % 50 == 0, 0.0).otherwise(F.col("lat"))
    return t.poi(spark, d).select(
        "poi_id", in_bounds("lat", "lng", box).alias("in_box"), in_bounds("lat", "lng", box, 0.035).alias("in_margin"),
        has_coordinates(lat0, "lng").alias("placed"),
    )


_double = re.compile(r"([0-9][0-9.]*(?:e[+-]?[0-9]+)?)D")


def _literal(match: re.Match) -> str:
    return match[1] if "e" in match[1] else match[1] + "e0"


def _projected_sql() -> str:
    """The same series as nested selects."""
    source = f"SELECT poi_id, (lng - 127) * 88000 + 200000 AS x, (lat - 38) * 111000 AS y FROM ({t.CTES['poi']})"
    out = []
    for epsg, (*_, north) in PROJECTIONS.items():
        text = f"SELECT *, y + {north} AS n FROM ({source})"
        for step in projection_steps("x", "n", epsg):
            named = ", ".join(f"{_double.sub(_literal, e)} AS {name}" for name, e in step.items())
            hidden = " EXCLUDE (" + ", ".join(step) + ")" if "_lat" in step and "_gx" in text else " EXCLUDE (_n)" if "_n" in step and "_lat" in text else ""
            text = f"SELECT *{hidden}, {named} FROM ({text})"
        rounded = ", ".join(f"round_even(degrees({c}) * 1e7, 0) / 1e7 AS {n}_{epsg}" for c, n in (("_lat", "lat"), ("_lng", "lng")))
        out.append(f"(SELECT poi_id, {rounded} FROM ({text}))")
    return f"SELECT * FROM {out[0]} JOIN {out[1]} USING (poi_id) JOIN {out[2]} USING (poi_id)"


@query("projected_coordinates", _projected_sql())
def projected_coordinates(spark, d):
    """Projected metres around every place, in all three systems, to degrees."""
    rows = t.poi(spark, d).selectExpr("poi_id", "(lng - 127) * 88000 + 200000 AS x", "(lat - 38) * 111000 AS y")
    names = []
    for epsg, (*_, north) in PROJECTIONS.items():
        rows = rows.withColumn("n", F.col("y") + north)
        rows = projected_to_wgs84(rows, "x", "n", epsg, f"lat_{epsg}", f"lng_{epsg}")
        names += [f"lat_{epsg}", f"lng_{epsg}"]
    return rows.select("poi_id", *[half_even(c, 7).alias(c) for c in names])


@query(
    "park_sizes",
    """SELECT o_orderkey, area, CASE WHEN area >= 100000 THEN '대형공원' WHEN area >= 10000 THEN '중형공원' ELSE '소형공원' END AS size FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS area FROM orders)""",
)
def park_sizes(spark, d):
    number = F.format_number(F.floor("o_totalprice"), 0)
    text = F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.concat(F.lit("약 "), number, F.lit("m2")))
    rows = t.read(spark, d, "orders").select("o_orderkey", tx.first_integer(text).alias("area"))
    return rows.withColumn("size", tx.park_size("area"))


_LINES = ["서울교통공사 1호선", "한국철도공사", "코레일 경의  중앙선", "수도권 도시철도 9호선", "신분당선"]


@query(
    "line_names",
    f"""SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace({sql_pick(_LINES, 'p_partkey')}, '{"|".join(tx.LINE_OPERATORS)}', '', 'g'), '\\s+', ' ', 'g')), '') AS line,
    coalesce(CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_name END, p_brand) AS name FROM part""",
)
def line_names(spark, d):
    first = F.when(F.col("p_partkey") % 2 == 0, F.lit(" ")).otherwise(F.col("p_name"))
    return t.read(spark, d, "part").select(
        "p_partkey", tx.line_name(pick(_LINES, "p_partkey")).alias("line"), tx.first_of(first, "p_brand").alias("name")
    )


_TOPICS = [("study", ["école", "school", "Schule"]), ("transport", ["train", "bus", "Bahn"]), ("the", ["the ", "The "]), ("que", ["que"]), ("der", ["der"])]


@query(
    "document_topics",
    f"SELECT {sql_first('text', _TOPICS, 'other')} AS topic, array_to_string({sql_all('text', _TOPICS)}, '|') AS every, count(*) AS n FROM documents GROUP BY 1, 2",
)
def document_topics(spark, d):
    """The keyword rules over whole documents: first match and all matches."""
    docs = t.read(spark, d, "documents").select(
        rules.first_match("text", _TOPICS, "other").alias("topic"),
        F.array_join(rules.all_matches("text", _TOPICS), "|").alias("every"),
    )
    return docs.groupBy("topic", "every").agg(F.count("*").alias("n"))


# --- Chargers and stations ----------------------------------------------------------------------
_CHARGERS = f"""SELECT l_partkey % 97 AS station, l_suppkey, l_orderkey, l_linenumber, l_quantity,
  {sql_pick(['01', '02', '06', '07'], 'l_partkey')} AS kind, CASE WHEN l_quantity > 40 THEN '100' ELSE '7' END AS output,
  {sql_pick(LIMITS, 'l_orderkey')} AS limited, {sql_pick(['Y', 'N', '무료주차', ''], 'l_orderkey')} AS free, (l_linenumber % 5)::VARCHAR AS stat FROM lineitem"""


def charger_rows(spark, d):
    rows = t.read(spark, d, "lineitem").select(
        F.expr("l_partkey % 97").alias("s"), "l_suppkey", "l_quantity", pick(["01", "02", "06", "07"], "l_partkey").alias("kind"),
        F.when(F.col("l_quantity") > 40, "100").otherwise("7").alias("output"), pick(LIMITS, "l_orderkey").alias("limited"),
        pick(["Y", "N", "무료주차", ""], "l_orderkey").alias("free_text"), F.expr("cast(l_linenumber % 5 as string)").alias("stat"),
        F.lit(None).cast("string").alias("none"),
    )
    return rows.where(~stations.is_closed("none", "stat", "none")).select(
        F.when(F.col("s") % 2 == 0, F.col("s").cast("string")).alias("station_id"),
        F.concat(F.lit("충전소 "), F.col("s").cast("string")).alias("name"), F.lit("서울").alias("address"),
        (F.lit(37.5) + F.col("s") / 1000).alias("lat"), (F.lit(127.0) + F.col("s") / 1000).alias("lng"),
        F.lit("운영").alias("operator"), F.lit("24시간").alias("use_time"), "kind",
        stations.is_fast("kind", "output", "none").alias("fast"), stations.is_restricted("limited", "none").alias("restricted"),
        stations.is_free_parking("free_text").alias("free"), stations.is_available("stat", "none").alias("available"),
    )


@query(
    "station_rollup",
    f"""SELECT '충전소 ' || station AS name, count(*) AS charger_count, count(*) FILTER (fast) AS fast_count, count(*) FILTER (NOT fast) AS slow_count,
    count(*) FILTER (restricted) AS restricted_count, count(*) FILTER (NOT restricted) AS public_count, count(*) FILTER (free) AS free_parking_count,
    count(*) FILTER (stat = '2') AS available_count, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS charger_types FROM (
    SELECT station, kind, stat, output = '100' OR kind IN ('01', '06') AS fast, limited IN ('Y') OR (limited NOT IN ('N', '없음', '') AND {sql_any('limited', stations.SHUT_WORDS)}) AS restricted,
    free IN ('Y', '무료주차') AS free FROM ({_CHARGERS}) WHERE stat <> '4') GROUP BY station""",
)
def station_rollup(spark, d):
    return stations.charger_stations(charger_rows(spark, d)).select(
        "name", "charger_count", "fast_count", "slow_count", "restricted_count", "public_count", "free_parking_count",
        "available_count", "charger_types",
    )


@query(
    "charger_access",
    """SELECT *, CASE WHEN score >= 75 THEN '높음' WHEN score >= 55 THEN '좋음' WHEN score >= 30 THEN '보통' ELSE '낮음' END AS level FROM (
    SELECT l_suppkey, CAST(greatest(0, least(100, CASE WHEN a > 0 THEN 45 WHEN b > 0 THEN 35 WHEN c > 0 THEN 20 ELSE 0 END
    + least(b, 5) * 5 + least(f, 10) * 2 + least(p, 10) - least(r, 10) * 2)) AS INT) AS score FROM (
    SELECT l_suppkey, count(*) FILTER (l_quantity < 2) AS a, count(*) FILTER (l_quantity < 3) AS b, count(*) FILTER (l_quantity < 10) AS c,
    count(*) FILTER (l_discount > 0.09) AS f, count(*) FILTER (l_tax < 0.01) AS p, count(*) FILTER (l_discount < 0.01) AS r FROM lineitem GROUP BY 1))""",
)
def charger_access(spark, d):
    counts = t.read(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.expr("count_if(l_quantity < 2)").alias("a"), F.expr("count_if(l_quantity < 3)").alias("b"), F.expr("count_if(l_quantity < 10)").alias("c"),
        F.expr("count_if(l_discount > 0.09D)").alias("f"), F.expr("count_if(l_tax < 0.01D)").alias("p"), F.expr("count_if(l_discount < 0.01D)").alias("r"),
    )
    score = stations.charger_access("a", "b", "c", "f", "p", "r")
    return counts.select("l_suppkey", score.alias("score")).withColumn("level", stations.access_level("score"))


@query(
    "park_facilities",
    f"""SELECT park, CAST(sum(n) AS BIGINT) AS total, array_to_string(list_filter(list_sort_order, lambda x: list_contains(list(g), x))[1:1], '') AS primary_group, any_value(tags) AS tags FROM (
    SELECT c_mktsegment AS park, 1 + c_custkey % 5 AS n, {sql_first('label', rules.FACILITY_GROUPS, '기타')} AS g, [{", ".join(repr(x) for x in rules.FACILITY_PRIORITY)}] AS list_sort_order
    FROM (SELECT *, {sql_pick(PHRASES, 'c_custkey')} AS label FROM customer)) JOIN (
    SELECT park, array_to_string(list_filter([{", ".join(repr(x) for x, _ in rules.FACILITY_TAGS)}], lambda x: list_contains(ts, x))[1:4], '|') AS tags FROM (
    SELECT c_mktsegment AS park, flatten(list({sql_all('label', rules.FACILITY_TAGS)})) AS ts FROM (SELECT *, {sql_pick(PHRASES, 'c_custkey')} AS label FROM customer) GROUP BY 1)) USING (park)
    GROUP BY park, list_sort_order""",
)
def park_facilities(spark, d):
    rows = t.read(spark, d, "customer").select(
        F.col("c_mktsegment").alias("park"), pick(PHRASES, "c_custkey").alias("facility"), F.expr("1 + c_custkey % 5").alias("count")
    )
    found = stations.park_facilities(rows)
    return found.select("park", "total", "primary_group", F.array_join("tags", "|").alias("tags"))


def _metres_sql(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)"
    return f"round_even(2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - ({h}))), 0)"


_STATION_NEAR = f"coalesce(list_position(list_transform(st, lambda c: {_metres_sql('c', 'r')} <= 350), true), 0)"
_STATION_WALK = f"""WITH named AS (
  SELECT CAST(p_partkey // 4 AS VARCHAR) AS name, list({{'lat': 37.5e0 + (p_partkey // 4) / 10000e0 + p_partkey % 4 * 0.0012e0, 'lng': 127e0, 'line': p_brand}} ORDER BY p_partkey) AS rows
  FROM part GROUP BY 1
), walked AS (
  SELECT name, list_reduce(rows, lambda st, r: CASE WHEN {_STATION_NEAR} = 0 THEN list_append(st, {{'lat': r.lat, 'lng': r.lng, 'n': 1::BIGINT, 'lines': [r.line]}})
    ELSE list_transform(st, lambda c, i: CASE WHEN i = {_STATION_NEAR} THEN {{'lat': c.lat + (r.lat - c.lat) / (c.n + 1), 'lng': c.lng + (r.lng - c.lng) / (c.n + 1),
      'n': c.n + 1, 'lines': list_append(c.lines, r.line)}} ELSE c END) END,
    CAST([] AS STRUCT(lat DOUBLE, lng DOUBLE, n BIGINT, lines VARCHAR[])[])) AS st FROM named
)
SELECT name, CAST(seq - 1 AS INTEGER) AS seq, c.n AS n, round_even(c.lat * 1e7, 0) / 1e7 AS lat, array_to_string(list_sort(list_distinct(c.lines)), '/') AS lines, len(list_distinct(c.lines)) >= 2 AS is_transfer
FROM (SELECT name, unnest(st) AS c, unnest(range(1, len(st) + 1)) AS seq FROM walked)"""


@query("station_clusters", _STATION_WALK)
def station_clusters(spark, d):
    """Platforms of one name near each other become one station; four rows share a name."""
    key = F.col("p_partkey")
    rows = t.read(spark, d, "part").select(
        key.alias("ord"), key.cast("string").alias("station_id"), F.floor(key / 4).cast("string").alias("name"), F.col("p_brand").alias("line"),
        (F.lit(37.5) + F.floor(key / 4) / 10000 + key % 4 * 0.0012).alias("lat"), F.lit(127.0).alias("lng"),
    )
    found = stations.cluster_stations(rows)
    return found.select("name", "seq", "n", half_even("lat", 7).alias("lat"), F.array_join("lines", "/").alias("lines"), "is_transfer")


@query(
    "charger_inside_complex",
    """SELECT c_custkey, length(n) >= 3 AND contains(s, n) AS inside FROM (SELECT c_custkey, lower(regexp_replace(c_name, '[^0-9a-zA-Z가-힣]', '', 'g')) AS n,
    lower(regexp_replace(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'elsewhere' END || ' 충전소 ' || c_mktsegment, '[^0-9a-zA-Z가-힣]', '', 'g')) AS s FROM customer)""",
)
def charger_inside_complex(spark, d):
    rows = t.read(spark, d, "customer").select(
        "c_custkey", "c_name", "c_mktsegment",
        F.concat(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit("elsewhere")), F.lit(" 충전소")).alias("station"),
    )
    return rows.select("c_custkey", stations.inside_complex("c_name", "station", "c_mktsegment").alias("inside"))


@query(
    "school_access_score",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 10 WHEN m <= 150 THEN 95 WHEN m <= 300 THEN 88 WHEN m <= 500 THEN 78 WHEN m <= 800 THEN 62
    WHEN m <= 1200 THEN 45 WHEN m <= 1500 THEN 30 ELSE 15 END AS score FROM (SELECT o_orderkey, o_orderkey * 3 % 2000 AS m FROM orders)""",
)
def school_access_score(spark, d):
    rows = t.read(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 3 % 2000 END AS m"
    )
    return rows.select("o_orderkey", display.school_score("m").alias("score"))
