"""Data-quality checks of scored tables: one pass per table, one long report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import CITY_BOUNDS, in_bounds
from .scoring import valid


@dataclass(frozen=True)
class TableSpec:
    """What a table promises."""

    name: str
    required: Sequence[str]
    primary_metric: str | None = None
    json_columns: Sequence[str] = ()
    radius_rules: Sequence[tuple[str, str]] = ()
    percent_columns: Sequence[str] = ()
    key: str = "name"
    expected_rows: int | None = None
    bounds: tuple[float, float, float, float] = field(default=CITY_BOUNDS)


def _bad_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _is_numeric(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")


def dq_checks(df: DataFrame, spec: TableSpec) -> DataFrame:
    """``(table, check, level, n)``: n offending rows (values), level OK, WARN or ERROR.

    All row checks are aggregates of a single scan. Duplicate keys need a grouping of their own,
    folded into the same report.
    """
    have = set(df.columns)
    checks: list[tuple[str, str, Column]] = []
    missing = [c for c in spec.required if c not in have]
    checks.append(("required_columns", "ERROR", F.lit(len(missing)).cast("long")))
    if {"lat", "lng"} <= have:
        known = valid("lat").isNotNull() & valid("lng").isNotNull()
        checks.append(("coordinates_numeric", "ERROR", F.count_if(~known)))
        outside = known & ~in_bounds(valid("lat"), valid("lng"), spec.bounds)
        checks.append(("coordinates_in_bounds", "WARN", F.count_if(outside)))
    else:
        wanted = {"lat", "lng"} & set(spec.required)
        checks.append(("coordinates_numeric", "ERROR" if wanted else "WARN", F.lit(1).cast("long")))
    for column in spec.json_columns:
        text = F.trim(F.col(column))
        empty = F.col(column).isNull() | (text == "")
        checks.append((f"json_parse:{column}", "ERROR", _bad_if(~empty & F.try_parse_json(text).isNull())))
        checks.append((f"json_empty:{column}", "WARN", _bad_if(empty)))
    numeric = [c for c in df.columns if _is_numeric(df, c)]
    groups = {
        "negative_counts": [c for c in numeric if "_count" in c],
        "negative_distances": [c for c in numeric if "distance" in c and "_count" not in c],
    }
    for name, columns in groups.items():
        total = F.lit(0).cast("long")
        for column in columns:
            total = total + _bad_if(valid(column) < 0)
        checks.append((name, "ERROR", total))
    for small, large in spec.radius_rules:
        checks.append((f"radius_order:{small}<={large}", "WARN", _bad_if(valid(small) > valid(large))))
    for column in spec.percent_columns:
        checks.append((f"percent_range:{column}", "ERROR", _bad_if(~valid(column).between(0, 100))))
        checks.append((f"percent_empty:{column}", "WARN", _bad_if(valid(column).isNull())))
    if spec.primary_metric:
        raw = F.col(spec.primary_metric)
        blank = raw.isNull() | (F.trim(raw.cast("string")) == "")
        checks.append(("primary_metric_invalid", "ERROR", _bad_if(~blank & valid(raw.try_cast("double")).isNull())))
        checks.append(("primary_metric_empty", "WARN", _bad_if(blank)))
    rows = F.count("*")
    if spec.expected_rows is not None:
        rows_off = F.abs(rows - F.lit(spec.expected_rows))
        checks.append(("row_count", "WARN", rows_off))
    checks.append(("rows_present", "ERROR", F.when(rows == 0, 1).otherwise(0).cast("long")))
    one = df.agg(*[c.cast("long").alias(f"c{k}") for k, (_, _, c) in enumerate(checks)])
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.lit(level).alias("_level"), F.col(f"c{k}").alias("n"))
            for k, (name, level, _) in enumerate(checks)
        ]
    )
    report = one.select(F.explode(entries).alias("e")).select("e.*")
    repeated = (
        df.where(F.trim(F.col(spec.key)) != "").groupBy(F.trim(F.col(spec.key)).alias("k"))
        .agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
        .select(F.lit("duplicate_names").alias("check"), F.lit("WARN").alias("_level"), "n")
    )
    level = F.when(F.col("n") == 0, "OK").otherwise(F.col("_level"))
    return report.unionByName(repeated).select(F.lit(spec.name).alias("table"), "check", level.alias("level"), "n")


def coverage_checks(source: DataFrame, master: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of the source missing in the master, and the other way round."""
    a = source.select(key).where(F.col(key).isNotNull()).distinct()
    b = master.select(key).where(F.col(key).isNotNull()).distinct()

    def side(left, right, check):
        return left.join(right, key, "left_anti").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table"), F.lit(check).alias("check"),
            F.when(F.col("n") == 0, "OK").otherwise("WARN").alias("level"), "n",
        )

    return side(a, b, "missing_in_master").unionByName(side(b, a, "missing_in_source"))


def expected_rows(tables: Sequence[DataFrame]) -> int:
    """The largest row count among the tables (one number per table reaches the driver)."""
    return max(t.count() for t in tables)
