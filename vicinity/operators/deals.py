"""Deals: normalising records, removing repeats, and summaries per site and floor area."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.display import area_label, count_text, date_text, floor_text, money_text, rent_text
from ..functions.geo import half_even

# Windows in days, trend margin, the 84 m2 band, area tab and row limits.
DAYS_3M, DAYS_6M, DAYS_1Y = 93, 183, 365
TREND_MARGIN = 0.03
TREND_LEAST = 2
BAND_84 = (80, 90)
TAB_LEAST, TAB_SHARE, TAB_MOST = 5, 0.03, 5
ROWS_PER_TAB = 80
DEAL_KEY = [
    "transaction_type", "deal_type", "gu", "dong", "road_name", "bonbun", "bubun", "apartment_name",
    "deal_date", "area_m2", "floor", "deal_amount", "deposit_amount", "monthly_rent",
]


def normalise(raw: DataFrame, first_year: int) -> DataFrame:
    """Typed deals from raw text columns; unusable rows are dropped.

    ``raw``: ``region, apartment_name, road_name, lot, bonbun, bubun, year_month, day, area, price,
    deposit, monthly, floor, built, housing_type, transaction_type, source_file``. Dropped: other
    housing types, years before ``first_year``, rows without name, date, or price (deposit).
    """
    sido, gu, dong = tx.split_region("region")
    trade = F.col("transaction_type") == "trade"
    parts = raw.where(F.coalesce(tx.clean("housing_type"), F.lit("아파트")) == "아파트").withColumns(
        {
            "_sido": sido, "_gu": gu, "_dong": dong, "_lot": F.coalesce(tx.clean("lot"), tx.compose_lot("bonbun", "bubun")),
            "_main": tx.lot_part("bonbun"), "_monthly": F.coalesce(tx.money("monthly"), F.lit(0)),
        }
    )
    halves = F.split("_lot", "-", 2)
    parts = parts.withColumns(
        {
            "_sub": F.when(F.col("_main").isNotNull(), tx.lot_part("bubun")).otherwise(
                tx.lot_part(F.try_element_at(halves, F.lit(2)))
            ),
            "_first": F.coalesce("_main", tx.lot_part(F.get(halves, F.lit(0)))),
            "_road": tx.road_address("_sido", "_gu", "road_name"),
        }
    )
    rows = parts.select(
        "transaction_type",
        F.when(trade, "매매").when(F.col("_monthly") > 0, "월세").otherwise("전세").alias("deal_type"),
        F.col("_sido").alias("sido"), F.col("_gu").alias("gu"), F.col("_dong").alias("dong"),
        F.col("_lot").alias("jibun"), F.col("_first").alias("bonbun"),
        F.when(F.col("_sub") != "0", F.col("_sub")).alias("bubun"),
        tx.clean("road_name").alias("road_name"), F.col("_road").alias("road_address"),
        tx.normalize_address("_road").alias("normalized_road_address"),
        tx.clean("apartment_name").alias("apartment_name"),
        tx.normalize_name("apartment_name").alias("normalized_apartment_name"),
        tx.contract_date("year_month", "day").alias("deal_date"),
        tx.number("area").alias("area_m2"), tx.whole("floor").alias("floor"), tx.whole("built").alias("built_year"),
        F.when(trade, tx.money("price")).alias("deal_amount"),
        F.when(~trade, tx.money("deposit")).alias("deposit_amount"),
        F.when(~trade, F.col("_monthly")).alias("monthly_rent"),
        "source_file",
    )
    usable = (
        F.col("apartment_name").isNotNull()
        & (F.year("deal_date") >= first_year)
        & F.coalesce("deal_amount", "deposit_amount").isNotNull()
    )
    return rows.where(usable).withColumns(
        {"contract_year": F.year("deal_date"), "contract_month": F.month("deal_date")}
    )


def dedupe(deals: DataFrame, key: list[str] = DEAL_KEY, order: str | None = None) -> DataFrame:
    """One row per 14-column key: the first by ``order``, any one when the rest is equal too."""
    if order is None:
        return deals.dropDuplicates(key)
    rest = [c for c in deals.columns if c not in key]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return deals.groupBy(*key).agg(first).select(*key, "_first.*")


def dedupe_stores(stores: DataFrame, digits: int = 5, order: str = "poi_id") -> DataFrame:
    """One store per coordinate rounded to ``digits`` decimals: the first by ``order``."""
    keyed = stores.withColumns(
        {"_lat": half_even("lat", digits), "_lng": half_even("lng", digits)}
    )
    first = F.min_by(F.struct(*stores.columns), order).alias("_first")
    return keyed.groupBy("_lat", "_lng").agg(first).select("_first.*")


def _latest(value: str, test: Column, fields: tuple[str, ...]) -> Column:
    usable = test & F.col("deal_date").isNotNull() & F.col(value).isNotNull()
    order = F.struct("deal_date", "deal_key", value, "area_m2", "floor")
    return F.max(F.when(usable, F.struct(order.alias("o"), *fields)))


def deal_summary(sites: DataFrame, deals: DataFrame, as_of: datetime.date) -> DataFrame:
    """Counts, averages, latest deals, ratio, trend and price per area of every site.

    One grouping of conditional aggregates; ``as_of`` is given, never the clock. Equal dates are
    decided by the remaining deal columns.
    """
    day = F.lit(as_of)
    trade, rent = F.col("transaction_type") == "trade", F.col("transaction_type") == "rent"
    jeonse = rent & (F.coalesce("monthly_rent", F.lit(0)) == 0)
    monthly = rent & (F.col("monthly_rent") > 0)
    within = lambda days: F.col("deal_date") >= F.date_sub(day, days)
    count = lambda test, days: F.count_if(F.coalesce(test & within(days), F.lit(False)))
    average = lambda test, value: F.avg(F.when(test, F.col(value)))
    year = within(DAYS_1Y)
    recent, prior = trade & within(DAYS_6M), trade & year & ~within(DAYS_6M)
    band = F.col("area_m2").between(*BAND_84)
    stats = deals.groupBy("site_id").agg(
        count(trade, DAYS_3M).alias("trade_count_3m"), count(trade, DAYS_1Y).alias("trade_count_1y"),
        count(rent, DAYS_3M).alias("rent_count_3m"), count(rent, DAYS_1Y).alias("rent_count_1y"),
        count(jeonse, DAYS_3M).alias("jeonse_count_3m"), count(jeonse, DAYS_1Y).alias("jeonse_count_1y"),
        count(monthly, DAYS_3M).alias("monthly_count_3m"), count(monthly, DAYS_1Y).alias("monthly_count_1y"),
        half_even(average(trade & year, "deal_amount"), 1).alias("avg_trade_amount_1y"),
        half_even(average(jeonse & year, "deposit_amount"), 1).alias("avg_rent_deposit_1y"),
        half_even(average(trade & band, "deal_amount"), 1).alias("avg_trade_amount_84"),
        half_even(average(jeonse & band, "deposit_amount"), 1).alias("avg_rent_amount_84"),
        F.max(F.when(trade & year, F.col("deal_amount"))).alias("max_trade_amount_1y"),
        F.min(F.when(trade & year, F.col("deal_amount"))).alias("min_trade_amount_1y"),
        _latest("deal_amount", trade, ("deal_amount", "deal_date", "area_m2")).alias("_trade"),
        _latest("deposit_amount", jeonse, ("deposit_amount", "deal_date")).alias("_rent"),
        F.count(F.when(recent, F.col("deal_amount"))).alias("_recent_n"),
        F.count(F.when(prior, F.col("deal_amount"))).alias("_prior_n"),
        average(recent, "deal_amount").alias("_recent"), average(prior, "deal_amount").alias("_prior"),
    )
    trend = (
        F.when((F.col("_recent_n") < TREND_LEAST) | (F.col("_prior_n") < TREND_LEAST), "insufficient")
        .when(F.col("_recent") >= F.col("_prior") * (1 + TREND_MARGIN), "up")
        .when(F.col("_recent") <= F.col("_prior") * (1 - TREND_MARGIN), "down")
        .otherwise("flat")
    )
    amount, deposit = F.col("_trade.deal_amount"), F.col("_rent.deposit_amount")
    counts = [c for c in stats.columns if "_count_" in c]
    out = sites.select("site_id").join(stats, "site_id", "left").withColumns(
        {
            "latest_trade_amount": amount,
            "latest_trade_date": F.col("_trade.deal_date"),
            "latest_rent_deposit": deposit,
            "latest_rent_date": F.col("_rent.deal_date"),
            "jeonse_ratio": F.when((amount != 0) & (deposit != 0), half_even(deposit / amount * 100, 1)),
            "price_per_m2": F.when((amount != 0) & (F.col("_trade.area_m2") != 0), half_even(amount / F.col("_trade.area_m2"), 1)),
            "recent_trade_trend": F.when(F.col("_recent_n").isNull(), "insufficient").otherwise(trend),
        }
    )
    return out.drop("_trade", "_rent", "_recent_n", "_prior_n", "_recent", "_prior").fillna(0, counts)


def latest_deals(deals: DataFrame, value: str = "deal_amount") -> DataFrame:
    """The latest deal with a usable amount per site."""
    best = _latest(value, F.lit(True), (value, "deal_date", "area_m2", "floor"))
    out = deals.groupBy("site_id").agg(best.alias("_b")).where("_b IS NOT NULL")
    return out.select("site_id", *[F.col(f"_b.{c}").alias(c) for c in (value, "deal_date", "area_m2", "floor")])


def label_number(label: Column | str) -> Column:
    """Number inside an area label, 9999 when there is none."""
    digits = F.regexp_replace(label, "[^0-9]", "")
    return F.coalesce(digits.try_cast("int"), F.lit(9999))


def area_counts(deals: DataFrame) -> DataFrame:
    """Deals per site and area label: counts by kind and the latest amounts."""
    kind = F.col("filter_type")
    trade, rent = F.col("transaction_type") == "trade", F.col("transaction_type") == "rent"
    grouped = deals.withColumn("area_label", area_label("area_m2")).groupBy("site_id", "area_label").agg(
        F.count("*").alias("count"),
        F.count_if(kind == "sale").alias("sale_count"),
        F.count_if(kind == "jeonse").alias("jeonse_count"),
        F.count_if(kind == "monthly").alias("monthly_count"),
        _latest("deal_amount", trade, ("deal_amount",)).alias("_sale"),
        _latest("deposit_amount", rent, ("deposit_amount",)).alias("_rent"),
    )
    return grouped.withColumns(
        {"latest_sale": F.col("_sale.deal_amount"), "latest_rent": F.col("_rent.deposit_amount")}
    ).drop("_sale", "_rent")


def area_tabs(counts: DataFrame) -> DataFrame:
    """Tab order and which tabs are primary: enough deals, a share of the largest, top five.

    The largest tab is primary when none qualifies. Works on one row per site and label.
    """
    site = Window.partitionBy("site_id")
    order = site.orderBy(F.desc("count"), label_number("area_label"), "area_label")
    ranked = counts.withColumns(
        {"place": F.row_number().over(order), "_largest": F.max("count").over(site)}
    )
    enough = (
        (F.col("count") >= TAB_LEAST)
        & (F.col("count") / F.col("_largest") >= TAB_SHARE)
        & (F.col("place") <= TAB_MOST)
    )
    return ranked.withColumn("is_primary", enough | (F.col("place") == 1)).drop("_largest")


def representative_area(tabs: DataFrame) -> DataFrame:
    """The area with most sales that has a price; ties go to the earlier tab."""
    priced = tabs.where("sale_count > 0 AND latest_sale IS NOT NULL")
    best = F.max_by(
        F.struct("area_label", "latest_sale", "sale_count"), F.struct("sale_count", -F.col("place"))
    )
    return priced.groupBy("site_id").agg(best.alias("_b")).select("site_id", "_b.*")


def _kind_rank() -> Column:
    return F.when(F.col("filter_type") == "sale", 0).when(F.col("filter_type") == "jeonse", 1).otherwise(2)


def capped_deals(deals: DataFrame, cap: int = ROWS_PER_TAB) -> DataFrame:
    """The newest ``cap`` deals per site, area label and kind (the rank filter runs map-side too)."""
    value = F.coalesce("deal_amount", "deposit_amount")
    order = Window.partitionBy("site_id", "area_label", "filter_type").orderBy(
        F.desc("deal_date"), F.desc("deal_key"), F.desc(value), F.desc("area_m2"), F.desc("floor"),
        F.desc("monthly_rent"),
    )
    labelled = deals.withColumn("area_label", area_label("area_m2"))
    return labelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def detail_payloads(deals: DataFrame) -> DataFrame:
    """One JSON payload per site: area tabs, and capped deals by area.

    A deal shows its ``dong`` and ``apartment_name`` where ``deals`` has these columns, else blanks.
    """
    tabs = area_tabs(area_counts(deals))
    tab = F.struct(
        "place", "area_label", "count", count_text("count").alias("count_label"),
        *(c for kind in ("sale", "jeonse", "monthly") for c in (f"{kind}_count", count_text(f"{kind}_count").alias(f"{kind}_count_label"))),
        "is_primary",
    )
    own = lambda name: (F.coalesce(F.trim(name), F.lit("")) if name in deals.columns else F.lit(""))
    tab_lists = tabs.groupBy("site_id").agg(F.array_sort(F.collect_list(tab)).alias("_tabs"))
    kind = F.element_at(
        F.create_map(*[F.lit(x) for x in ("sale", "매매", "jeonse", "전세", "monthly", "월세")]), F.col("filter_type")
    )
    shown = F.struct(
        F.datediff(F.lit(datetime.date(2100, 1, 1)), "deal_date").alias("_age"), (-_kind_rank()).alias("_kind"), "rank",
        kind.alias("type"), "filter_type", date_text("deal_date").alias("date"),
        F.when(F.col("transaction_type") == "trade", money_text("deal_amount")).otherwise(rent_text("deposit_amount", "monthly_rent")).alias("price"),
        "area_label", floor_text("floor").alias("floor"), own("dong").alias("dong"), own("apartment_name").alias("apt_name"),
    )
    by_area = capped_deals(deals).groupBy("site_id", "area_label").agg(
        F.transform(
            F.array_sort(F.collect_list(shown)), lambda x: x.dropFields("_age", "_kind", "rank")
        ).alias("_rows")
    )
    areas = by_area.groupBy("site_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("area_label", "_rows")))).alias("_areas")
    )
    payload = F.struct(
        F.transform("_tabs", lambda x: x.dropFields("place")).alias("area_tabs"),
        F.col("_areas").alias("transactions_by_area"),
    )
    return tab_lists.join(areas, "site_id").select("site_id", F.to_json(payload).alias("payload"))


def area_prices(deals: DataFrame) -> DataFrame:
    """Average, lowest, highest and latest price per site, area and kind (sale, jeonse)."""
    value = F.coalesce("deal_amount", "deposit_amount")
    listed = deals.where("filter_type <> 'monthly'").withColumns(
        {"area_label": area_label("area_m2"), "amount": value}
    ).where("amount IS NOT NULL")
    grouped = listed.groupBy("site_id", "area_label", "filter_type").agg(
        F.count("*").alias("count"),
        F.avg("amount").alias("_avg"), F.min("amount").alias("low"), F.max("amount").alias("high"),
        F.max(F.struct("deal_date", "deal_key", "amount")).alias("_latest"),
    )
    span = F.concat(money_text("low"), F.lit(" ~ "), money_text("high"))
    return grouped.select(
        "site_id", "area_label", "filter_type", "count",
        F.col("_latest.amount").alias("latest"), half_even("_avg").cast("long").alias("average"),
        money_text("_avg").alias("average_text"), span.alias("range_text"),
    )


def insight_badges(summary: DataFrame, tabs: DataFrame) -> DataFrame:
    """Up to four badges per site from its yearly counts and largest area."""
    best = tabs.groupBy("site_id").agg(
        F.sum("monthly_count").alias("_monthly"),
        F.min_by("area_label", "place").alias("_area"),
    )
    rows = summary.join(best, "site_id", "left")
    trades, rents = F.col("trade_count_1y"), F.col("rent_count_1y")
    total = trades + rents
    size = F.when(F.col("_area").rlike("[0-9]"), label_number("_area"))
    badges = F.array_compact(
        F.array(
            F.when(total >= 100, "거래 활발").when(total >= 10, "최근 거래 있음"),
            F.when((rents >= 10) & (rents > trades * 3), "전월세 수요 높음"),
            F.when(F.col("_monthly") > 0, "월세 거래 있음"),
            F.when(size <= 60, "소형 거래 중심").when(size >= 84, "중대형 거래 있음"),
        )
    )
    shown = (
        F.when(total == 0, F.array(F.lit("데이터 부족")))
        .when(F.size(badges) == 0, F.array(F.lit("최근 거래 있음")))
        .otherwise(F.slice(badges, 1, 4))
    )
    return rows.select("site_id", shown.alias("badges"))
