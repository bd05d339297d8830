"""Display texts, score fallbacks and keys used at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col, half_even


def two_decimals(value) -> Column:
    return F.format_string("%.2f", half_even(value, 2))


def clamp(value, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


def money_text(amount) -> Column:
    """``1.2억`` from 10,000 units of 10,000 on, else ``9,500만원``."""
    whole = F.rint(col(amount).cast("double"))
    big = F.format_string("%.1f억", half_even(whole / 10000, 1))
    small = F.concat(F.format_number(whole, 0), F.lit("만원"))
    return F.when(whole.isNull(), F.lit("")).when(whole >= 10000, big).otherwise(small)


def rent_text(deposit, monthly) -> Column:
    rent = F.coalesce(col(monthly), F.lit(0))
    both = F.concat(
        F.lit("보증금 "), money_text(deposit), F.lit(" / "), F.format_number(F.rint(rent.cast("double")), 0), F.lit("만원")
    )
    return F.when(rent > 0, both).otherwise(money_text(deposit))


def count_text(count) -> Column:
    return F.format_number(F.coalesce(col(count), F.lit(0)).cast("long"), 0)


def distance_text(metres) -> Column:
    return F.when(col(metres).isNull(), "").otherwise(
        F.concat(F.format_number(F.rint(col(metres).cast("double")), 0), F.lit("m"))
    )


def percent_text(value) -> Column:
    return F.when(col(value).isNull(), "").otherwise(F.format_string("%.1f%%", half_even(value, 1)))


def date_text(day) -> Column:
    return F.coalesce(F.date_format(col(day), "yyyy.MM.dd"), F.lit(""))


def floor_text(floor) -> Column:
    return F.when(col(floor).isNull(), "").otherwise(F.concat(col(floor).cast("int").cast("string"), F.lit("층")))


def area_label(area) -> Column:
    """Half-even whole square metres, e.g. ``84㎡``."""
    return F.when(col(area).isNull(), "면적 미상").otherwise(
        F.concat(F.rint(col(area).cast("double")).cast("int").cast("string"), F.lit("㎡"))
    )


def percentile_score(percentile) -> Column:
    value = col(percentile).cast("double")
    return F.coalesce(half_even(clamp(F.lit(100.0) - value)), F.lit(0.0)).cast("int")


# Distance steps of the school score, and score by number of facilities.
SCHOOL_STEPS = [(150, 95), (300, 88), (500, 78), (800, 62), (1200, 45), (1500, 30)]
COUNT_STEPS = [(10, 90), (5, 75), (3, 55), (1, 35)]


def school_score(distance) -> Column:
    """95 at the door down to 15 beyond 1.5 km; unknown distance 10."""
    d = col(distance)
    out = F.when(d.isNull(), 10)
    for limit, score in SCHOOL_STEPS:
        out = out.when(d <= limit, score)
    return out.otherwise(15)


def count_score(count) -> Column:
    n = F.coalesce(col(count), F.lit(0))
    out = None
    for least, score in COUNT_STEPS:
        out = F.when(n >= least, score) if out is None else out.when(n >= least, score)
    return out.otherwise(10)


def summary_score(percentile, own_percentile, key, school_distance, score, count) -> Column:
    """The score shown: percentile, else the school rule, else the raw score, else by count."""
    pct = F.coalesce(col(percentile), col(own_percentile))
    raw = col(score).cast("double")
    return (
        F.when(pct.isNotNull(), percentile_score(pct))
        .when(col(key) == "school-environment", school_score(school_distance))
        .when(raw.between(0, 100), F.rint(raw).cast("int"))
        .otherwise(count_score(count))
    )


def area_mix_text(columns: Sequence[str]) -> Column:
    labels = ["60㎡ 이하", "60~85㎡", "85~135㎡", "135㎡ 초과"]
    parts = [
        F.concat(F.lit(f"{label} "), count_text(c), F.lit("세대")) for label, c in zip(labels, columns)
    ]
    return F.concat_ws(" / ", *parts)


def parking_per_household(parking, households) -> Column:
    ratio = half_even(col(parking).cast("double") / F.nullif(col(households).cast("double"), F.lit(0.0)), 2)
    return F.when(col(parking) > 0, ratio)


def deal_months(as_of, count: int = 3) -> Column:
    """The last ``count`` months as ``YYYYMM``, newest first."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda k: F.date_format(F.add_months(col(as_of), -k), "yyyyMM"),
    )


def local_day(ts_utc, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts_utc), zone))


def day_floor(today, days: int) -> Column:
    """First day of a window of ``days`` days that ends today; NULL means everything."""
    return F.date_sub(col(today), days - 1) if days > 0 else F.lit(None).cast("date")


def visitor_hash(ip, user_agent, day, seed: str) -> Column:
    """16 hex digits of sha256 over address, agent and the salt of the day."""
    salt = F.concat_ws("|", F.lit(seed), F.date_format(col(day), "yyyy-MM-dd"))
    raw = F.concat_ws("|", F.coalesce(col(ip), F.lit("")), F.coalesce(col(user_agent), F.lit("")), salt)
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 16)


def weight_combo(preferences, default: int = 3) -> Column:
    """``key=value`` pairs of the non-default weights, sorted, joined by ``;``."""
    changed = F.map_filter(col(preferences), lambda k, v: v != default)
    return _pairs(changed)


def filter_combo(filters) -> Column:
    """``key=a,b`` pairs of the active filters (``map<string, array<string>>``), sorted."""
    active = F.transform_values(
        col(filters), lambda k, v: F.array_sort(F.filter(v, lambda x: x.isNotNull() & (x != "")))
    )
    active = F.map_filter(active, lambda k, v: F.size(v) > 0)
    return _pairs(F.transform_values(active, lambda k, v: F.array_join(v, ",")))


def _pairs(values: Column) -> Column:
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(
        F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";"
    )


def encode_share(payload) -> Column:
    """URL-safe base64 of a struct as JSON, without padding."""
    text = F.base64(F.encode(F.to_json(col(payload)), "UTF-8"))
    return F.rtrim(F.translate(F.regexp_replace(text, r"\s", ""), "+/", "-_"), F.lit("="))


def decode_share(token, schema: str, max_chars: int = 6000) -> Column:
    """The struct back; blank, too long or broken tokens give NULL."""
    text = F.trim(col(token))
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    json = F.try_to_binary(padded, F.lit("base64")).cast("string")
    usable = (text != "") & (F.length(text) <= max_chars)
    return F.from_json(F.when(usable, json), schema)
