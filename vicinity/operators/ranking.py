"""Score maps per site, preference-weighted ranking, ranking tables and pair comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_even
from .scoring import valid

# Display order of category cards.
CATEGORY_ORDER = [
    "subway", "bus-baseline", "bus", "school-environment", "school-zone", "academy", "large_mart",
    "super_mart", "warehouse_mart", "convenience", "ev-charger", "bike", "hospital",
    "general-hospital", "emergency-room", "pharmacy", "cctv", "fire-station", "fire", "cafe", "park",
    "hangang", "culture", "commercial", "shopping", "nightlife",
]


def site_scores(baselines: Mapping[str, DataFrame], key: Sequence[str] = ("site_id",)) -> DataFrame:
    """``scores`` and ``percentiles`` maps per site from several scored baselines.

    Each baseline has the key, ``pct`` and ``score``. All are stacked and grouped once, so the
    number of baselines does not change the number of shuffles.
    """
    long = None
    for name, df in baselines.items():
        part = df.select(*key, F.lit(name).alias("category"), valid("score").alias("score"), valid("pct").alias("pct"))
        long = part if long is None else long.unionByName(part)
    return score_maps(long, key)


def score_maps(long: DataFrame, key: Sequence[str] = ("site_id",)) -> DataFrame:
    """Maps from long rows ``(key, category, score, pct)``; missing scores leave no entry."""
    best = long.groupBy(*key, "category").agg(F.max(F.struct("score", "pct")).alias("_s"))
    entry = F.when(F.col("_s.score").isNotNull(), F.struct("category", "_s.score", "_s.pct"))
    entries = best.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))

    def mapped(field: str) -> Column:
        return F.map_from_entries(F.transform("_e", lambda x: F.struct(x["category"], x[field])))

    return entries.select(*key, mapped("score").alias("scores"), mapped("pct").alias("percentiles"))


def weighted_score(scores: Column | str, preferences: Mapping[str, float]) -> Column:
    """Half-even weighted mean over the categories that have a score and a positive weight."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    total, weights = F.lit(0.0), F.lit(0.0)
    for category, weight in preferences.items():
        if not weight or float(weight) <= 0:
            continue
        value = F.try_element_at(scores, F.lit(category))
        total = total + F.coalesce(value * float(weight), F.lit(0.0))
        weights = weights + F.when(value.isNotNull(), F.lit(float(weight))).otherwise(0.0)
    return F.when(weights > 0, half_even(total / weights)).otherwise(0.0).cast("int")


def rank_sites(
    scores: DataFrame,
    preferences: Mapping[str, float],
    limit: int = 5,
    ties: Sequence[str] = ("gu", "dong", "name"),
) -> DataFrame:
    """Best sites first; only ``limit`` rows per task reach the final merge."""
    ranked = scores.withColumn("score", weighted_score("scores", preferences))
    return ranked.orderBy(F.desc("score"), *ties).limit(limit)


def ranking_debug(
    df: DataFrame,
    direction: str,
    *,
    sort: str = "score_desc",
    limit: int = 100,
    bottom: bool = False,
    gu: str | None = None,
    dong: str | None = None,
    query: str | None = None,
) -> DataFrame:
    """Ranked rows of one metric (``value``, ``pct``, ``score``) under one of four orders.

    ``rank`` is the position in the whole filtered result, also for the bottom rows: the last
    ``limit`` rows come from the reversed order and their rank is counted down from the total.
    """
    if gu:
        df = df.where(F.col("gu") == gu)
    if dong:
        df = df.where(F.col("dong") == dong)
    if query:
        df = df.where(F.contains("name", F.lit(query)))
    value, pct, score = valid("value"), valid("pct"), valid("score")
    better = value if direction == "lower" else -value
    unranked = lambda *cols: F.greatest(*[c.isNull().cast("int") for c in cols]) if len(cols) > 1 else cols[0].isNull().cast("int")
    keys = {
        "score_desc": [unranked(score, value), F.coalesce(-score, F.lit(0.0)), F.coalesce(better, F.lit(0.0))],
        "percentile_asc": [unranked(pct, value), F.coalesce(pct, F.lit(0.0)), F.coalesce(better, F.lit(0.0))],
        "raw_desc": [unranked(value), F.coalesce(-value, F.lit(0.0)), unranked(score), F.coalesce(-score, F.lit(0.0))],
        "raw_asc": [unranked(value), F.coalesce(value, F.lit(0.0)), unranked(score), F.coalesce(-score, F.lit(0.0))],
    }[sort] + [F.col("name"), F.col("gu"), F.col("dong")]
    if not bottom:
        top = df.orderBy(*[k.asc() for k in keys]).limit(limit)
        order = Window.orderBy(*[k.asc() for k in keys])
        return top.withColumn("rank", F.row_number().over(order).cast("long"))
    last = df.orderBy(*[k.desc() for k in keys]).limit(limit)
    order = Window.orderBy(*[k.desc() for k in keys])
    total = df.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))
    return (
        last.withColumn("_back", F.row_number().over(order))
        .withColumn("_one", F.lit(1))
        .join(total, "_one")
        .withColumn("rank", F.col("_total") - F.col("_back") + 1)
        .drop("_one", "_back", "_total")
    )


def compare_sites(scores: DataFrame, left: Column, right: Column, hidden: Sequence[str] = ()) -> DataFrame:
    """Category by category: both scores and the winner, ``a``, ``b`` or ``tie``.

    ``scores`` is long ``(site key…, category, score)``; ``left`` and ``right`` pick one site each
    and reach the scan as filters.
    """
    shown = lambda c: F.when(~F.col("category").isin(list(hidden)) if hidden else F.lit(True), F.col(c))
    a = scores.where(left).select("category", shown("score").alias("a_score"))
    b = scores.where(right).select("category", shown("score").alias("b_score"))
    winner = (
        F.when(F.col("a_score") > F.col("b_score"), "a")
        .when(F.col("b_score") > F.col("a_score"), "b")
        .when(F.col("a_score") == F.col("b_score"), "tie")
    )
    return a.join(b, "category").withColumn("winner", winner)


def comparison_wins(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count_if(F.col("winner") == "a").alias("win_a"),
        F.count_if(F.col("winner") == "b").alias("win_b"),
    )


def display_position(category: Column | str) -> Column:
    """Position of a category card; unknown ones come last."""
    category = F.col(category) if isinstance(category, str) else category
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category)
    return F.when(place == 0, F.lit(len(CATEGORY_ORDER))).otherwise(place - 1).cast("int")
