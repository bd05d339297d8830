"""Searching sites by several conditions at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.display import distance_text
from ..functions.text import normalize_search
from .radius import within_named

# Points, default bonuses, most labels, subtypes per search category.
SCHOOL_RADIUS_M = 1500
NEAR_SUBWAY_M = 800
MAX_LABELS = 8
BALANCED = "생활 균형형"
PRIORITY_SUBTYPES: dict[str, list[str]] = {
    "academy": ["독서실", "영어", "중국어", "일본어", "수학", "예체능", "직업/자격", "입시/보습", "기타"],
    "medical": ["응급실", "종합병원", "소아과", "산부인과"],
    "culture": ["공연", "전시", "체육", "키즈", "체험"],
    "park": ["일반공원", "한강공원", "대형공원"],
    "convenience": ["CU", "GS25", "세븐일레븐", "이마트24"],
    "super_mart": rules.MART_GROUPS["super_mart"][1],
    "large_mart": rules.MART_GROUPS["large_mart"][1],
    "warehouse_mart": rules.MART_GROUPS["warehouse_mart"][1],
    "cafe": [name for name, _ in rules.BRAND_RULES["cafe"]],
}
CULTURE_COLUMNS = dict(zip(PRIORITY_SUBTYPES["culture"], ("performance_count", "exhibition_count", "sports_count", "kids_count", "experience_count")))
PARK_PRESENCE_M = {"일반공원": 1000, "한강공원": 3000, "대형공원": 3000}
TEXT_KEYS = (
    "gu", "dong", "line", "station", "assigned_elementary", "school", "household", "price_type", "price",
    "bus_type", "bus_route", "no_nightlife",
)


@dataclass(frozen=True)
class Priority:
    """One infrastructure wish: where its count and nearest distance are in the wide table."""

    category: str
    subtype: str
    count: str
    nearest: str | None = None

    @property
    def sorts_only(self) -> bool:
        return self.category == "academy"


def presence(distance: str, subtype: str) -> Column:
    """1 when a park of that kind is near enough, else 0."""
    return F.coalesce((F.col(distance) <= PARK_PRESENCE_M[subtype]).cast("int"), F.lit(0))


def stat_columns(category: str, subtype: str) -> tuple[str, str]:
    """The columns of a derived wish: its count and its nearest distance."""
    return f"{category}_{subtype}_count", f"{category}_{subtype}_nearest"


def derived_wish(category: str, subtype: str) -> Priority:
    return Priority(category, subtype, *stat_columns(category, subtype))


def _stats(category: str, found: Mapping[str, tuple[Column, Column]]) -> list[Column]:
    out = []
    for subtype, (count, near) in found.items():
        names = stat_columns(category, subtype)
        out += [F.coalesce(count.cast("long"), F.lit(0)).alias(names[0]), near.cast("double").alias(names[1])]
    return out


def medical_stats(table: DataFrame, walk_m: int = 500) -> DataFrame:
    """Counts and nearest distances of medical wishes by ``site_id``.

    Emergency rooms and general hospitals are reached by car and have columns of their own. Specialties are counted on
    foot: the column ``<specialty>_count_500m`` where there is one with a value, else the items within ``walk_m``; the
    nearest always comes from the items (``medical_items``: array with ``subtype, distance``).
    """
    emergency, general, *clinics = PRIORITY_SUBTYPES["medical"]
    found = {
        emergency: (F.col("emergency_count_1km"), F.col("nearest_emergency_distance")),
        general: (F.col("superior_hospital_count_5km"), F.col("nearest_superior_hospital_distance")),
    }
    for name in clinics:
        walked = F.filter("medical_items", lambda x: x["distance"] <= walk_m)
        near = F.filter(walked, lambda x: F.trim(x["subtype"]) == name)  # noqa: B023 - used at once
        counted = F.greatest(F.size(near), F.lit(0))
        column = f"{name}_count_500m"
        count = F.coalesce(F.col(column).cast("long"), counted) if column in table.columns else counted
        found[name] = (count, F.array_min(F.transform(near, lambda x: x["distance"])))
    return table.select("site_id", *_stats("medical", found))


def culture_stats(table: DataFrame) -> DataFrame:
    """Counts of culture wishes by ``site_id``; all share the nearest place of culture."""
    near = F.col("nearest_culture_distance")
    return table.select("site_id", *_stats("culture", {name: (F.col(c), near) for name, c in CULTURE_COLUMNS.items()}))


def park_stats(table: DataFrame) -> DataFrame:
    """Presence (0 or 1) and distance of park wishes by ``site_id``, from the nearest park of each kind."""
    columns = dict(zip(PRIORITY_SUBTYPES["park"], ("park_distance", "hangang_distance", "big_park_distance")))
    return table.select("site_id", *_stats("park", {name: (presence(c, name), F.col(c)) for name, c in columns.items()}))


def parse_priorities(texts: Sequence[str], subtypes: Mapping[str, Sequence[str]] = PRIORITY_SUBTYPES) -> list[tuple[str, str]]:
    """``category:subtype`` texts in order; unknown ones and repeated subtypes are dropped."""
    kept: dict[str, str] = {}
    for text in texts:
        category, _, subtype = (text or "").partition(":")
        category, subtype = category.strip(), subtype.strip()
        if subtype in subtypes.get(category, ()):
            kept.setdefault(subtype, category)
    return [(category, subtype) for subtype, category in kept.items()]


def normalize_filters(raw: Mapping[str, object]) -> dict[str, object]:
    """Known keys only; invalid buckets and types become blank."""
    out: dict[str, object] = {k: str(raw.get(k) or "").strip() for k in TEXT_KEYS}
    if out["price_type"] not in ("trade", "jeonse"):
        out["price_type"] = "trade"
    prices = rules.TRADE_BUCKETS if out["price_type"] == "trade" else rules.JEONSE_BUCKETS
    if out["price"] not in [b[0] for b in prices]:
        out["price"] = ""
    if out["household"] not in [b[0] for b in rules.HOUSEHOLD_BUCKETS]:
        out["household"] = ""
    if out["bus_type"] not in rules.BUS_LABEL_ORDER:
        out["bus_type"] = ""
    areas = raw.get("area_buckets") or raw.get("area") or []
    areas = [areas] if isinstance(areas, str) else areas
    out["area_buckets"] = [a for a in areas if a in dict(rules.AREA_BUCKETS)]
    wishes = raw.get("priority") or raw.get("priorities") or []
    wishes = [wishes] if isinstance(wishes, str) else wishes
    out["priorities"] = parse_priorities([w if isinstance(w, str) else ":".join(w) for w in wishes])
    return out


def has_filters(filters: Mapping[str, object]) -> bool:
    return any(filters.get(k) for k in (*TEXT_KEYS, "area_buckets", "priorities") if k != "price_type")


def scenario_steps(base: Mapping[str, object], *additions: Mapping[str, object]) -> list[dict[str, object]]:
    """Filters that grow step by step, each holding all before it."""
    steps = [dict(base)]
    for extra in additions:
        steps.append({**steps[-1], **extra})
    return steps


def _bucket(buckets, key):
    return next(((low, high) for name, low, high in buckets if name == key), None)


def explore(
    wide: DataFrame,
    filters: Mapping[str, object],
    *,
    priorities: Sequence[Priority] = (),
    schools: DataFrame | None = None,
    limit: int | None = 10,
) -> DataFrame:
    """Sites that meet every condition, with ``score``, ``labels`` and the best ``limit`` first.

    ``wide`` is one row per site: ``subway_lines``, ``station_names`` (arrays, within 500 m),
    ``nightlife_count_500m``, ``assigned_elementary``, area bucket columns, ``households``,
    ``trade_price``, ``jeonse_price``, ``bus_routes`` (``map<type, array<route>>``),
    ``subway_distance``, ``emergency_distance`` and the columns the priorities name. Only the
    conditions in use enter the plan. Missing values exclude a site.
    """
    get = lambda k: str(filters.get(k) or "").strip()
    rows, tests, labels, score = wide, [], [], F.lit(0)

    def require(test: Column, label: Column | None = None, points: int = 0):
        nonlocal score
        tests.append(F.coalesce(test, F.lit(False)))
        if label is not None:
            labels.append(label)
        score = score + points

    if get("gu"):
        require(F.col("gu") == get("gu"))
    if get("dong"):
        require(F.col("dong") == get("dong"))
    if get("line"):
        require(F.array_contains("subway_lines", get("line")), F.lit(f"{get('line')} 접근"), 3)
    if get("station"):
        name = get("station").replace("역", "")
        wanted = name.replace(" ", "").lower()
        own = F.transform("station_names", lambda s: normalize_search(F.replace(s, F.lit("역"), F.lit(""))))
        require(F.array_contains(own, wanted), F.lit(f"{name}역 접근"), 3)
    if filters.get("no_nightlife"):
        require(F.col("nightlife_count_500m") == 0, F.lit("반경 500m이내 유흥시설 없음"), 1)
    if get("assigned_elementary"):
        require(F.col("assigned_elementary") == get("assigned_elementary"), F.lit(f"{get('assigned_elementary')} 배정"), 2)
    if get("school"):
        near = within_named(wide, schools, get("school"), SCHOOL_RADIUS_M).withColumnRenamed("distance_m", "_school_m")
        rows = rows.join(near, "site_id")
        labels.append(F.concat(F.lit(get("school") + " "), distance_text("_school_m")))
        score = score + 2
    areas = [column for key, column in rules.AREA_BUCKETS if key in (filters.get("area_buckets") or ())]
    if areas:
        require(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in areas], F.lit(0)) > 0)
    household = _bucket(rules.HOUSEHOLD_BUCKETS, get("household"))
    if household:
        inside = (F.col("households") > 0) & rules.in_bucket("households", *household)
        require(inside, F.lit(f"세대수 {get('household')}"), 1)
    jeonse = get("price_type") == "jeonse"
    price = _bucket(rules.JEONSE_BUCKETS if jeonse else rules.TRADE_BUCKETS, get("price"))
    if price:
        column = "jeonse_price" if jeonse else "trade_price"
        require(rules.in_bucket(column, *price), F.lit(f"{'전세' if jeonse else '매매'} {get('price')}"), 1)
    kind, route = get("bus_type"), get("bus_route")
    if route:
        routes = F.try_element_at("bus_routes", F.lit(kind)) if kind else F.flatten(F.map_values("bus_routes"))
        require(F.array_contains(routes, route), F.lit(f"{kind} {route}".strip()), 2)
    elif kind:
        require(F.size(F.try_element_at("bus_routes", F.lit(kind))) > 0, F.lit(f"{kind}버스"), 1)
    order: list[Column] = []
    for wish in priorities:
        count = F.coalesce(F.col(wish.count), F.lit(0))
        order.append(count.desc())
        shown = F.concat(F.lit(f"{wish.subtype} "), count.cast("string"), F.lit("곳"))
        if wish.sorts_only:
            labels.append(F.when(count > 0, shown))
            continue
        if wish.category == "park":
            shown = F.concat(F.lit(f"{wish.subtype} "), distance_text(wish.nearest))
        require(count >= 1, shown)
        if wish.nearest:
            order.append(F.col(wish.nearest).asc_nulls_last())
    if not priorities:
        bonus = lambda test: F.coalesce(test, F.lit(False)).cast("int")
        score = score + bonus(F.col("subway_distance") <= NEAR_SUBWAY_M) + bonus(F.col("emergency_distance").isNotNull())
        order.append(F.desc("score"))
    for test in tests:
        rows = rows.where(test)
    found = F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")
    shown = F.when(F.size(found) > 0, F.slice(found, 1, MAX_LABELS)).otherwise(F.array(F.lit(BALANCED)))
    result = rows.withColumns({"score": score, "labels": shown}).orderBy(*order, "gu", "dong", "name")
    return result if limit is None else result.limit(limit)


def area_mix(wide: DataFrame) -> DataFrame:
    """Share of each area bucket among a site's households, and parking places per household."""
    columns = [column for _, column in rules.AREA_BUCKETS]
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    shares = [
        F.rint(F.coalesce(F.col(c), F.lit(0)) * 1000.0 / F.nullif(total, F.lit(0))).cast("int").alias(f"{c}_permille")
        for c in columns
    ]
    return wide.select("site_id", total.alias("bucket_total"), *shares)
