"""Keyword classifiers: ordered rules, first match wins; multi-label rules build arrays.

Every table below holds fixed values: the keywords, their order and the labels decide results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

Rules = Sequence[tuple[str, Sequence[str]]]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def joined(*columns: Column | str) -> Column:
    """The non-empty parts joined by one blank."""
    parts = [F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in columns]
    return F.concat_ws(" ", *parts)


def first_match(text: Column | str, rules: Rules, default: str | None, *, fold: bool = False) -> Column:
    """Label of the first rule one of whose words is in the text; ``fold`` ignores case."""
    text = F.coalesce(col(text), F.lit(""))
    if fold:
        text = F.lower(text)
    out = None
    for label, words in rules:
        words = [w.lower() for w in words] if fold else words
        test = contains_any(text, words)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def all_matches(text: Column | str, rules: Rules) -> Column:
    """Labels of all rules that match, in rule order."""
    text = F.coalesce(col(text), F.lit(""))
    return F.array_compact(
        F.array(*[F.when(contains_any(text, words), F.lit(label)) for label, words in rules])
    )


def by_priority(labels: Column | str, order: Sequence[str]) -> Column:
    """The labels present, deduplicated and in priority order."""
    return F.array_intersect(F.array(*[F.lit(x) for x in order]), col(labels))


def banded(value: Column | str, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first band whose floor the value reaches (bands go downwards)."""
    value = col(value)
    out = None
    for floor, label in bands:
        test = value >= floor
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def bucket_of(value: Column | str, buckets: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Key of the half-open bucket ``[low, high)`` that holds the value; NULL for missing."""
    value = col(value)
    out = F.lit(None).cast("string")
    for key, low, high in reversed(buckets):
        out = F.when(in_bucket(value, low, high), F.lit(key)).otherwise(out)
    return out


def in_bucket(value: Column | str, low: float | None, high: float | None) -> Column:
    value = col(value)
    inside = value.isNotNull()
    if low is not None:
        inside = inside & (value >= low)
    if high is not None:
        inside = inside & (value < high)
    return F.coalesce(inside, F.lit(False))


# --- Bus routes -------------------------------------------------------------------------
BUS_TYPES = ("main", "local", "express", "night", "village", "airport")
BUS_LABELS = {
    "express": "광역", "main": "간선", "local": "지선", "village": "마을",
    "night": "심야", "airport": "공항", "unknown": "기타",
}
BUS_LABEL_ORDER = ["광역", "간선", "지선", "마을", "심야", "공항", "기타"]


def bus_type(route: Column | str) -> Column:
    """Route type from the route name; the letter rules come before the digit rules."""
    name = F.upper(F.trim(F.coalesce(col(route), F.lit(""))))
    digits = name.rlike("^[0-9]+$")
    size = F.length(name)
    return (
        F.when(name.rlike("^N"), "night")
        .when(name.rlike("^[MG]"), "express")
        .when(name.rlike("[가-힣]"), "village")
        .when(~digits, "unknown")
        .when(name.startswith("6"), "airport")
        .when((size == 4) & name.startswith("9"), "express")
        .when(size == 4, "local")
        .when(size == 3, "main")
        .when(name.startswith("9"), "express")
        .otherwise("unknown")
    )


def bus_label(route: Column | str) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in BUS_LABELS.items() for x in pair])
    return F.element_at(kinds, bus_type(route))


def stop_types(routes: Column | str) -> Column:
    """Route labels present at a stop, in priority order."""
    return by_priority(F.transform(col(routes), bus_label), BUS_LABEL_ORDER)


def primary_stop_type(routes: Column | str) -> Column:
    return F.coalesce(F.try_element_at(stop_types(routes), F.lit(1)), F.lit("기타"))


# --- Medical ----------------------------------------------------------------------------
HOSPITAL_SPECIALTIES = [
    ("치과", ["치과", "구강", "교정", "임플란트"]),
    ("한의원", ["한의원", "한방", "한의"]),
    ("안과", ["안과", "안센터"]),
    ("이비인후과", ["이비인후과", "이비인후"]),
    ("정형외과", ["정형외과", "관절", "척추"]),
    ("피부과", ["피부과", "피부"]),
    ("비뇨기과", ["비뇨기과", "비뇨"]),
    ("성형외과", ["성형외과"]),
    ("정신건강의학과", ["정신건강의학과", "정신과"]),
    ("재활의학과", ["재활의학과", "재활"]),
    ("가정의학과", ["가정의학과"]),
    ("소아과", ["소아청소년과", "소아과", "어린이"]),
    ("산부인과", ["산부인과", "여성의원"]),
    ("내과", ["내과", "건강검진", "검진"]),
    ("외과", ["외과"]),
]
PHARMACY_LATE_MINUTES = 22 * 60


def hospital_specialty(name, medical_class) -> Column:
    return first_match(joined(name, medical_class), HOSPITAL_SPECIALTIES, "기타")


def is_superior_hospital(medical_class, emergency_class) -> Column:
    return contains_any(joined(medical_class, emergency_class), ["상급종합병원", "종합병원"])


def clock_minutes(value) -> Column:
    """Minutes after midnight from HHMM text; NULL when it is no such time."""
    number = F.try_to_number(F.trim(col(value)), F.lit("9999")).cast("int")
    hour, minute = F.floor(number / 100), number % 100
    return F.when(hour.between(0, 24) & (minute < 60), hour * 60 + minute).cast("int")


def pharmacy_types(opens: Sequence[Column | str], closes: Sequence[Column | str]) -> Column:
    """Opening-hour labels from eight day columns (Mon..Sun, holiday); plain when none apply."""

    def filled(c) -> Column:
        return F.coalesce(F.trim(col(c)) != "", F.lit(False))

    late = F.lit(False)
    for close in closes:
        late = late | F.coalesce(clock_minutes(close) >= PHARMACY_LATE_MINUTES, F.lit(False))
    day = [filled(o) & filled(c) for o, c in zip(opens, closes)]
    labels = F.array_compact(
        F.array(
            F.when(late, F.lit("야간")),
            F.when(day[5] | day[6], F.lit("주말")),
            F.when(day[7], F.lit("휴일")),
        )
    )
    return F.when(F.size(labels) == 0, F.array(F.lit("일반"))).otherwise(labels)


# --- Education, culture, leisure --------------------------------------------------------
ACADEMY_RULES = [
    ("독서실", ["독서실", "스터디", "고시원"]),
    ("영어", ["영어", "토익", "토플", "텝스", "회화", "SAT", "IELTS"]),
    ("중국어", ["중국어", "HSK"]),
    ("일본어", ["일본어", "JLPT", "JPT"]),
    ("수학", ["수학", "초등수학", "중등수학", "고등수학", "수리"]),
    ("예체능", ["음악", "미술", "무용", "댄스", "연기", "연극", "뮤지컬", "실용음악", "피아노",
              "바이올린", "첼로", "성악", "체육", "태권도", "발레", "드럼", "기타"]),
    ("직업/자격", ["직업기술", "컴퓨터", "코딩", "정보처리", "통신기기", "인터넷", "소프트웨어",
                "미용", "간호", "바리스타", "요리", "회계", "세무", "부동산", "자격", "성인고시",
                "공무원", "편입", "전산", "전자", "디자인", "건축", "기계"]),
    ("입시/보습", ["보습", "논술", "입시", "검정", "진학", "국어", "과학", "사회", "종합", "교과",
                "초등", "중등", "고등"]),
]
CULTURE_RULES = [
    ("공연/행사", ["공연", "행사", "콘서트", "뮤지컬", "연극", "음악회", "무대"]),
    ("전시/관람", ["전시", "관람", "미술관", "박물관", "갤러리", "역사", "기록원"]),
    ("체육", ["체육", "테니스", "풋살", "축구", "농구", "수영", "스포츠", "체육관", "탁구",
            "배드민턴", "족구", "피클볼", "야구"]),
    ("키즈", ["키즈", "어린이", "아동", "유아", "아이", "놀이"]),
    ("체험", ["체험", "탐방", "투어", "도시농업", "공예", "취미", "생태", "정원", "숲"]),
    ("클래스", ["강좌", "교육", "수업", "클래스", "강의", "프로그램"]),
    ("자연/공원", ["공원", "산림", "캠핑", "자연", "둘레길", "숲길"]),
]
CULTURE_TOP = {"체육": "체육시설", "클래스": "교육강좌"}
CULTURE_STATUS = ["접수중", "안내중"]
CULTURE_TOP_KEPT = ["문화체험", "체육시설", "교육강좌"]
CULTURE_EXCLUDED = [
    "회의실", "강의실", "다목적실", "주민공유공간", "공유공간", "강당", "녹화장소", "민원",
    "청년공간", "청년정보", "진료", "복지", "상담", "대관", "공간시설", "업무", "사무",
]
NIGHTLIFE_RULES = [
    ("룸살롱", ["룸살롱"]),
    ("바/주점", ["스텐드바", "비어", "간이주점"]),
    ("클럽/나이트", ["카바레", "클럽", "디스코", "나이트"]),
]
FIRE_RULES = [("구조대", ["구조대"]), ("안전센터", ["안전센터", "119"])]
SCHOOL_RULES = [("elementary", ["초등"]), ("middle", ["중학"]), ("high", ["고등"])]
CAMERA_RULES = [
    ("생활방범", ["생활방범", "방범"]),
    ("어린이보호", ["어린이", "보호"]),
    ("교통/단속", ["교통", "단속"]),
    ("시설안전", ["시설"]),
]
MART_LIKE = [
    "이마트", "홈플러스", "롯데마트", "코스트코", "트레이더스", "GS더프레시", "GS수퍼", "GS슈퍼",
    "롯데슈퍼", "하나로마트", "식자재", "마트",
]
MART_LIKE_TYPES = ["대형마트"]
COMMERCIAL_TYPES = {
    "골목상권": "골목", "발달상권": "대형상권", "전통시장": "시장", "관광특구": "관광특구",
}


def academy_type(*columns) -> Column:
    return first_match(joined(*columns), ACADEMY_RULES, "기타", fold=True)


def culture_type(top, sub, name, place) -> Column:
    """Two labels also follow from the top category alone, at their place in the order."""
    text = joined(top, sub, name, place)
    out = None
    for label, words in CULTURE_RULES:
        test = contains_any(text, words)
        if label in CULTURE_TOP:
            test = test | F.coalesce(F.trim(col(top)) == CULTURE_TOP[label], F.lit(False))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("기타")


def culture_kept(status, top, sub, name, place) -> Column:
    return (
        F.trim(col(status)).isin(CULTURE_STATUS)
        & F.trim(col(top)).isin(CULTURE_TOP_KEPT)
        & ~contains_any(joined(top, sub, name, place), CULTURE_EXCLUDED)
    )


def nightlife_type(kind) -> Column:
    return first_match(F.trim(col(kind)), NIGHTLIFE_RULES, "기타")


def shopping_type(kind, name) -> Column:
    kind, name = F.coalesce(F.trim(col(kind)), F.lit("")), F.coalesce(F.trim(col(name)), F.lit(""))
    either = F.concat_ws(" ", kind, name)
    return (
        F.when(either.contains("백화점"), "백화점")
        .when(kind.contains("복합") | either.contains("쇼핑몰") | name.contains("몰"), "쇼핑몰")
        .when(either.contains("쇼핑센터"), "쇼핑몰")
        .when(either.contains("시장"), "시장")
        .when(kind.contains("전문점"), "전문점")
        .otherwise("기타쇼핑")
    )


def is_mart_like(kind, name) -> Column:
    words = [w.lower() for w in MART_LIKE]
    name = F.lower(F.coalesce(col(name), F.lit("")))
    return F.coalesce(F.trim(col(kind)).isin(MART_LIKE_TYPES), F.lit(False)) | contains_any(name, words)


def commercial_type(raw) -> Column:
    raw = F.nullif(F.trim(col(raw)), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in COMMERCIAL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, raw), raw, F.lit("기타"))


def open_business(status, detail=None) -> Column:
    """Licensed business in operation; ``detail`` adds the stricter second status."""
    if detail is None:
        return F.coalesce(F.trim(col(status)) == "영업/정상", F.lit(False))
    return F.coalesce(
        col(status).contains("영업/정상") & col(detail).contains("정상영업"), F.lit(False)
    )


# --- Riverside parks --------------------------------------------------------------------
FACILITY_GROUPS = [
    ("자전거", ["자전거"]),
    ("캠핑", ["캠핑", "야영"]),
    ("수상/레저", ["선착장", "계류", "수상", "요트", "카약", "보트", "수영장", "물놀이"]),
    ("운동시설", ["축구", "농구", "야구", "테니스", "배드민턴", "족구", "게이트볼", "골프", "운동",
              "체육", "인라인", "스케이트", "트랙"]),
    ("문화/휴식", ["분수", "광장", "무대", "전망", "생태", "잔디", "피크닉", "쉼터", "공연"]),
    ("편의시설", ["매점", "화장실", "주차장", "음수대", "그늘막", "휴게", "샤워", "탈의"]),
    ("접근시설", ["나들목", "승강기", "보행육교", "교량접속", "초록길", "제방"]),
]
FACILITY_PRIORITY = ["자전거", "운동시설", "수상/레저", "캠핑", "문화/휴식", "편의시설", "접근시설"]
FACILITY_TAGS = [
    ("자전거", ["자전거"]), ("캠핑", ["캠핑", "야영"]), ("수영장", ["수영장", "물놀이"]),
    ("농구장", ["농구"]), ("축구장", ["축구"]), ("테니스", ["테니스"]), ("야구장", ["야구"]),
    ("족구장", ["족구"]), ("분수", ["분수"]), ("광장", ["광장"]), ("선착장", ["선착장", "계류"]),
    ("매점", ["매점"]), ("주차장", ["주차장"]), ("화장실", ["화장실"]), ("나들목", ["나들목"]),
]
FACILITY_TAGS_SHOWN = 4


def facility_group(name) -> Column:
    return first_match(name, FACILITY_GROUPS, "기타")


def primary_facility_group(groups) -> Column:
    return F.coalesce(F.try_element_at(by_priority(groups, FACILITY_PRIORITY), F.lit(1)), F.lit("기타"))


# --- Brands -----------------------------------------------------------------------------
BRAND_RULES: dict[str, list[tuple[str, list[str]]]] = {
    "hospital": [
        ("치과", ["치과"]), ("내과", ["내과"]), ("소아과", ["소아", "소아청소년"]),
        ("산부인과", ["산부인과"]), ("정형외과", ["정형외과"]), ("안과", ["안과"]),
        ("이비인후과", ["이비인후과", "이비인후"]), ("피부과", ["피부과"]),
        ("정신건강의학과", ["정신건강", "정신과"]), ("대학병원", ["대학병원", "대학교병원"]),
        ("비뇨기과", ["비뇨기과", "비뇨"]), ("한의원", ["한의원", "한방"]),
        ("성형외과", ["성형외과", "성형"]), ("신경/통증의학과", ["신경", "통증"]),
        ("동물병원", ["동물", "동물병원", "가축"]),
    ],
    "cafe": [
        ("스타벅스", ["스타벅스"]), ("투썸플레이스", ["투썸", "투썸플레이스"]),
        ("메가MGC", ["메가MGC", "메가엠지씨", "MEGA MGC", "MEGAMGC"]),
        ("컴포즈커피", ["컴포즈", "컴포즈커피"]), ("이디야", ["이디야"]), ("빽다방", ["빽다방"]),
        ("할리스", ["할리스", "HOLLYS", "할리스커피"]),
        ("커피빈", ["커피빈", "커피 빈", "COFFEE BEAN", "COFFEEBEAN"]),
        ("폴바셋", ["폴바셋", "폴 바셋", "PAUL BASSETT", "PAULBASSETT"]),
        ("엔제리너스", ["엔제리너스", "엔젤리너스", "ANGELINUS", "ANGEL-IN-US"]),
    ],
    "mart": [
        ("트레이더스", ["트레이더스", "이마트트레이더스"]), ("코스트코", ["코스트코", "Costco"]),
        ("이마트에브리데이", ["이마트에브리데이", "에브리데이"]),
        ("홈플러스익스프레스", ["홈플러스익스프레스", "홈플러스 익스프레스", "익스프레스"]),
        ("롯데슈퍼프레시", ["롯데슈퍼프레시", "롯데슈퍼", "롯데프레시"]),
        ("노브랜드", ["노브랜드", "no brand", "nobrand"]),
        ("GS더프레시", ["GS더프레시", "GS더 프레시", "GS 더프레시", "GS THE FRESH", "지에스더프레시",
                     "지에스더 프레시"]),
        ("하나로마트", ["하나로마트", "하나로클럽"]), ("이마트", ["이마트", "emart", "E-MART"]),
        ("홈플러스", ["홈플러스", "Homeplus"]), ("롯데마트", ["롯데마트"]),
    ],
    "pharmacy": [
        ("W스토어", ["W스토어", "더블유스토어", "W STORE", "W-STORE"]), ("약국", ["약국"]),
    ],
    "convenience": [
        ("CU", ["CU ", "CU", "씨유"]), ("GS25", ["GS25", "지에스25"]),
        ("세븐일레븐", ["세븐일레븐", "7ELEVEN", "Seven Eleven"]), ("이마트24", ["이마트24", "emart24"]),
    ],
    "cctv": [
        ("생활방범", ["생활방범", "방범"]), ("어린이보호", ["어린이보호", "어린이", "보호"]),
        ("교통/단속", ["교통/단속", "교통", "단속"]), ("시설안전", ["시설안전", "시설"]),
    ],
    "park": [("대형공원", ["대형공원"]), ("중형공원", ["중형공원"]), ("소형공원", ["소형공원"])],
}
MART_GROUPS = {
    "large_mart": (3000, ["이마트", "홈플러스", "롯데마트"]),
    "super_mart": (500, ["이마트에브리데이", "홈플러스익스프레스", "롯데슈퍼프레시", "노브랜드",
                         "GS더프레시", "하나로마트"]),
    "warehouse_mart": (5000, ["코스트코", "트레이더스"]),
}


def brand(category: str, *text) -> Column:
    """Brand by the category's ordered rules, ignoring case; NULL when none matches."""
    return first_match(joined(*text), BRAND_RULES[category], None, fold=True)


def mart_group(brand_column) -> Column:
    groups = [(name, brands) for name, (_, brands) in MART_GROUPS.items()]
    out = F.lit(None).cast("string")
    for name, brands in groups:
        out = F.when(col(brand_column).isin(brands), name).otherwise(out)
    return out


# --- Grid layers (rules differ from the site rules on purpose) ------------------------------
def grid_academy_type(field, series) -> Column:
    field, series = F.coalesce(col(field), F.lit("")), F.coalesce(col(series), F.lit(""))
    return (
        F.when(contains_any(field, ["입시", "보습"]), "입시·보습")
        .when(field.contains("독서실"), "독서·논술")
        .when(field.contains("국제화") | series.contains("외국어"), "외국어")
        .when(field.contains("예능"), "예체능")
        .when(contains_any(field, ["기예", "직업", "기술"]), "직업·기술")
        .otherwise("기타")
    )


def grid_hospital_type(medical_class) -> Column:
    kind = F.coalesce(col(medical_class), F.lit(""))
    return (
        F.when(kind.isin("종합병원", "상급종합"), "종합병원")
        .when(kind.contains("치과"), "치과")
        .when(contains_any(kind, ["한의", "한방"]), "한의원")
        .when(kind.isin("병원", "요양병원"), "병원")
        .otherwise("의원")
    )


def grid_pharmacy_type(weekday_closes: Sequence[Column | str]) -> Column:
    """Night when a weekday closes at 22 or later; weekends do not count here."""
    late = F.lit(False)
    for close in weekday_closes:
        late = late | F.coalesce(
            F.trim(col(close)).rlike(r"^(2[2-9]|[3-9][0-9])."), F.lit(False)
        )
    return F.when(late, "야간(22시 이후)").otherwise("일반")


def grid_charger_type(restricted, public, fast, use_time) -> Column:
    closed = (col(restricted) > 0) & (col(public) == 0)
    residents = F.coalesce(col(use_time).contains("입주민"), F.lit(False))
    return (
        F.when(closed | residents, "이용제한")
        .when(col(fast) > 0, "급속(개방)")
        .otherwise("완속(개방)")
    )


# --- Bots -------------------------------------------------------------------------------
BOT_PATTERN = (
    r"(?i)bot\b|bot/|crawl|spider|slurp|mediapartners|adsbot|yeti|chatgpt|gptbot|oai-search|"
    r"anthropic|claude|perplexit|applebot|facebookexternal|meta-externalagent|embedly|semrush|"
    r"ahrefs|mj12|dotbot|blexbot|dataforseo|bytespider|ccbot|zgrab|masscan|censys|expanse|nikto|"
    r"python-requests|python-httpx|go-http-client|okhttp|libwww|curl/|wget|headlesschrome|"
    r"phantomjs|scrapy|node-fetch|axios|java/"
)


def is_bot(user_agent) -> Column:
    """Crawlers and HTTP clients; an empty user agent counts as a bot."""
    agent = F.coalesce(col(user_agent), F.lit(""))
    return (agent == "") | agent.rlike(BOT_PATTERN)


# --- Buckets, grades, wording -----------------------------------------------------------
AREA_BUCKETS = [
    ("u60", "area_under_60"), ("60_85", "area_60_85"), ("85_135", "area_85_135"),
    ("o135", "area_over_135"),
]
HOUSEHOLD_BUCKETS = [
    ("u300", None, 300), ("300_500", 300, 500), ("500_1000", 500, 1000),
    ("1000_2000", 1000, 2000), ("o2000", 2000, None),
]
TRADE_BUCKETS = [
    ("u100000", None, 100000), ("100000_150000", 100000, 150000), ("150000_200000", 150000, 200000),
    ("200000_300000", 200000, 300000), ("300000_350000", 300000, 350000), ("o350000", 350000, None),
]
JEONSE_BUCKETS = [
    ("u30000", None, 30000), ("30000_50000", 30000, 50000), ("50000_70000", 50000, 70000),
    ("70000_100000", 70000, 100000), ("100000_150000", 100000, 150000), ("o150000", 150000, None),
]
DOMAIN_GRADES = [(80, "S"), (65, "A"), (50, "B"), (35, "C")]
CATEGORY_GRADES = [(90, "S"), (70, "A"), (40, "B"), (15, "C")]
SCORE_CLASSES = [(70, "score-good"), (40, "score-normal")]
PERCENTILE_WORDS = [
    (5, "서울시 최상위권입니다"), (20, "서울시 기준 우수한 편입니다"), (60, "서울시 평균 수준입니다"),
    (80, "서울시 평균보다 다소 낮은 편입니다"),
]


def domain_grade(score) -> Column:
    return banded(F.coalesce(col(score), F.lit(0)), DOMAIN_GRADES, "D")


def category_grade(score) -> Column:
    return banded(F.coalesce(col(score), F.lit(0)), CATEGORY_GRADES, "D")


def score_class(score) -> Column:
    return banded(F.coalesce(col(score), F.lit(0)), SCORE_CLASSES, "score-low")


def percentile_class(percentile) -> Column:
    p = col(percentile)
    return F.when(p <= 20, "score-good").when(p >= 80, "score-low").otherwise("score-normal")


def percentile_words(percentile) -> Column:
    p = col(percentile)
    out = F.when(p.isNull(), "서울시 기준 상대평가는 참고용으로 확인하세요")
    for ceiling, words in PERCENTILE_WORDS:
        out = out.when(p <= ceiling, words)
    return out.otherwise("서울시 기준 부족한 편입니다")


def percentile_label(percentile, scope: str = "서울") -> Column:
    p = col(percentile)
    return (
        F.when(p.isNull(), F.lit(None))
        .when(p < 1, F.lit(f"{scope} 상위 1% 이내"))
        .otherwise(F.concat(F.lit(f"{scope} 상위 "), F.floor(p).cast("int").cast("string"), F.lit("%")))
    )
