"""Feature flags, insight features and score-based highlights of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import display_position

# Distances and counts that make a feature, and its priority (lower is first).
FEATURES: list[tuple[int, str, str, str]] = [
    (5, "9호선 접근", "good", "array_contains(subway_lines, '9호선')"),
    (8, "환승역 접근", "good", "transfer_count_1km > 0"),
    (10, "도보 역세권", "good", "subway_distance <= 500"),
    (12, "응급 의료 접근", "good", "emergency_distance <= 3000"),
    (14, "유흥시설 밀집", "caution", "nightlife_count_500m >= 10"),
    (16, "종합병원 생활권", "good", "general_hospital_count > 0"),
    (18, "차 없이 살기 좋은 곳", "good", "bus_count >= 5 AND subway_distance <= 800"),
    (20, "코스트코 접근", "good", "warehouse_count > 0"),
    (22, "한강 접근", "good", "riverside_distance <= 1500"),
    (24, "야간약국 접근", "good", "night_pharmacy_count > 0"),
    (26, "조용한 주거형", "calm", "nightlife_count_500m = 0"),
    (28, "대형마트 생활권", "good", "coalesce(warehouse_count, 0) = 0 AND mart_count >= 2"),
    (30, "공연·전시 생활권", "good", "show_count > 0"),
    (32, "키즈 체험 접근", "good", "kids_count > 0"),
    (34, "스타벅스 접근", "good", "starbucks_count > 0"),
    (35, "따릉이 접근", "good", "bike_count >= 3"),
    (36, "카페 밀집", "good", "coalesce(starbucks_count, 0) = 0 AND cafe_count >= 5"),
    (38, "학원 밀집형", "good", "academy_count >= 50"),
    (40, "전기차 충전 접근", "good", "ev_count > 0"),
]
LIFESTYLES: list[tuple[str, str]] = [
    ("도보생활형", "bus_count >= 5 AND subway_distance <= 800"),
    ("의료안심형", "emergency_distance <= 3000"),
    ("생활편의형", "cafe_count >= 5"),
    ("문화생활형", "show_count > 0"),
    ("육아형", "kids_count > 0"),
    ("휴식형", "riverside_distance <= 1500"),
    ("육아형", "academy_count >= 50"),
]
FLAGS: dict[str, str] = {
    "transfer": "transfer_count_1km > 0",
    "emergency": "emergency_distance <= 3000",
    "general_hospital": "general_hospital_count > 0",
    "warehouse": "warehouse_count > 0",
    "nightlife_low": "nightlife_count_500m = 0",
    "riverside": "riverside_distance <= 1500",
    "culture": "culture_count > 0",
}


def feature_flags(wide: DataFrame) -> DataFrame:
    """One boolean per searchable feature; missing metrics make it false."""
    flags = [F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in FLAGS.items()]
    return wide.select("site_id", *flags)


def feature_tags(limit: int = 6) -> Column:
    """The first ``limit`` features that hold, as ``struct(label, tone)``, by priority."""
    entries = [
        F.when(F.expr(rule), F.struct(F.lit(p).alias("p"), F.lit(label).alias("label"), F.lit(tone).alias("tone")))
        for p, label, tone, rule in FEATURES
    ]
    first = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, limit)
    return F.transform(first, lambda x: x.dropFields("p"))


def lifestyles(limit: int = 4) -> Column:
    """The first ``limit`` different lifestyles whose rule holds, in the order of the rules."""
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(n)) for n, rule in LIFESTYLES])))
    return F.when(F.size(hits) == 0, F.array(F.lit("균형형"))).otherwise(F.slice(hits, 1, limit))


def site_insights(wide: DataFrame, percentiles: DataFrame, limit: int = 4) -> DataFrame:
    """Features, lifestyles, and up to ``limit`` strengths and cautions, each in the order of the category cards.

    ``percentiles`` is long: ``(site_id, category, pct)``; a percentile of at most 20 is a strength, one of at least 85
    a caution. Near a transfer station ``transfer`` is the first strength; ten or more nightlife places make
    ``nightlife_dense`` the first caution. Nightlife and school environment are never cautions by their percentile.
    """
    quiet = F.col("category").isin("nightlife", "school-environment")
    entry = F.struct(display_position("category").alias("place"), "category")
    notes = percentiles.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pct") <= 20, entry))).alias("_strong"),
        F.array_sort(F.collect_list(F.when((F.col("pct") >= 85) & ~quiet, entry))).alias("_weak"),
    )
    none = F.array().cast("array<string>")

    def messages(rule: str, label: str, rest: str) -> Column:
        first = F.when(F.expr(rule), F.array(F.lit(label))).otherwise(none)
        return F.slice(F.concat(first, F.coalesce(F.transform(rest, lambda x: x["category"]), none)), 1, limit)

    tagged = wide.select(
        "site_id", feature_tags().alias("features"), lifestyles().alias("lifestyles"), "transfer_count_1km", "nightlife_count_500m"
    )
    return tagged.join(notes, "site_id", "left").select(
        "site_id", "features", "lifestyles",
        messages("transfer_count_1km > 0", "transfer", "_strong").alias("strengths"),
        messages("nightlife_count_500m >= 10", "nightlife_dense", "_weak").alias("cautions"),
    )


def score_highlights(scores: DataFrame, limit: int = 3) -> DataFrame:
    """The best three categories of a site with the wording 우수 (from 60) or 상대 강점."""
    shown = scores.where(
        ~F.col("category").isin("nightlife", "school-environment") & F.col("score").isNotNull()
    )
    order = Window.partitionBy("site_id").orderBy(F.desc("score"), "category")
    return (
        shown.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .withColumn("suffix", F.when(F.col("score") >= 60, "우수").otherwise("상대 강점"))
    )
