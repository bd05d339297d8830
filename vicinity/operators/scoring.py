"""Mid-rank percentiles, quantile breaks and break lookup.

Ranks come from a histogram of distinct values, never from a window over all rows: the
population is pre-aggregated on the map side, only distinct values are ordered, and the result
is joined back on the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_even
from ..session import cut

_RANGES = 255
ONE_TASK_ROWS = 1_000_000


def running_count(
    hist: DataFrame, value: str, count: str, by: tuple[str, ...] = (), one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Adds ``below`` (rows with a smaller value) and ``total`` per group to a histogram.

    ``hist`` has one row per (by, value). It is written out once, which tells its size: counts and
    whole metres have few distinct values, and a histogram of at most ``one_task_rows`` rows is
    ordered by one window. A larger one (continuous values) is ordered in ranges.
    """
    hist = cut(hist)
    if hist.count() > one_task_rows:
        return _running_count_in_ranges(hist, value, count, by)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumns(
        {"below": F.coalesce(F.sum(count).over(before), F.lit(0)), "total": F.sum(count).over(group)}
    )


def _running_count_in_ranges(hist: DataFrame, value: str, count: str, by: tuple[str, ...]) -> DataFrame:
    """The same, spread over tasks: values are cut into ranges at approximate quantiles.

    Rows are summed inside a range in parallel, and the per-range totals (at most 256 per group)
    are accumulated on top. The quantiles only place the cuts: the result is exact.
    """
    keyed = hist if by else hist.withColumn("_all", F.lit(1))
    keys = list(by) or ["_all"]
    points = F.array(*[F.lit((k + 1) / (_RANGES + 1)) for k in range(_RANGES)])
    cuts = keyed.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, points, F.lit(1000))).alias("_cuts")
    )
    placed = keyed.join(cuts, keys).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    before = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(F.sum(count).alias("_n"))
    across = Window.partitionBy(*keys)
    earlier = across.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(across).alias("total"),
    )
    return (
        placed.withColumn("_below", F.coalesce(F.sum(count).over(before), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn("below", F.col("_below") + F.col("_offset"))
        .drop("_below", "_offset", "_range", "_all")
    )


def valid(value: Column | str) -> Column:
    """A finite double, else NULL."""
    number = F.col(value) if isinstance(value, str) else value
    number = number.cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, number)


def _top_share(direction: str) -> Column:
    """Share of the population that is better, ties counted half, in percent."""
    if direction == "lower":
        better = F.col("below")
    else:
        better = F.col("total") - F.col("below") - F.col("n")
    return (better + 0.5 * F.col("n")) / F.col("total") * 100


def mid_rank(
    df: DataFrame, value: str, direction: str, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``pct`` (top percent, lower is better) and ``score`` = 100 - pct, two decimals.

    Missing and non-finite values keep NULL and are not part of the population.
    """
    df = df.withColumn("_v", valid(value))
    hist = df.where(F.col("_v").isNotNull()).groupBy(*partition_by, "_v").agg(
        F.count("*").alias("n")
    )
    ranked = running_count(hist, "_v", "n", partition_by)
    share = _top_share(direction)
    ranks = ranked.select(
        *partition_by,
        "_v",
        half_even(share, 2).alias("pct"),
        half_even(F.lit(100.0) - share, 2).alias("score"),
    )
    return df.join(ranks, [*partition_by, "_v"], "left").drop("_v")


def mid_rank_long(df: DataFrame, directions: dict[str, str], key: str = "site_id") -> DataFrame:
    """Many metrics at once: ``(key, metric, value, pct, score)``, one shuffle for all metrics."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), valid(name).alias("value"), F.lit(d).alias("better"))
            for name, d in directions.items()
        ]
    )
    melted = df.select(key, F.explode(pairs).alias("_m")).select(key, "_m.*")
    hist = melted.where(F.col("value").isNotNull()).groupBy("metric", "better", "value").agg(
        F.count("*").alias("n")
    )
    ranked = running_count(hist, "value", "n", ("metric", "better"))
    share = F.when(F.col("better") == "lower", _top_share("lower")).otherwise(_top_share("higher"))
    ranks = ranked.select(
        "metric",
        "value",
        half_even(share, 2).alias("pct"),
        half_even(F.lit(100.0) - share, 2).alias("score"),
    )
    return melted.drop("better").join(ranks, ["metric", "value"], "left")


def probe_top_percent(
    df: DataFrame, value: str, probes: DataFrame, direction: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """Whole top percent of each probe value against a population, at least 1.

    ``probes`` has ``by`` and ``probe``. The population is ranked once together with the
    probe values (as zero-count rows), so no probe scans it.
    """
    hist = (
        df.select(*by, valid(value).alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("n"))
    )
    asked = probes.select(*by, valid("probe").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    merged = (
        hist.unionByName(asked.withColumn("n", F.lit(0).cast("long")))
        .groupBy(*by, "_v")
        .agg(F.sum("n").alias("n"))
    )
    ranked = running_count(merged, "_v", "n", by)
    top = F.greatest(F.lit(1.0), half_even(_top_share(direction))).cast("int")
    return probes.withColumn("_v", valid("probe")).join(
        ranked.select(*by, "_v", F.when(F.col("total") > 0, top).alias("top_percent")),
        [*by, "_v"],
        "left",
    ).drop("_v")


def strict_percentile(df: DataFrame, value: str) -> DataFrame:
    """Older rule: ``100 - 100 * (rows strictly below) / n`` as ``legacy_pct``."""
    df = df.withColumn("_v", valid(value))
    hist = df.where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("n"))
    ranked = running_count(hist, "_v", "n")
    pct = half_even(F.lit(100.0) - F.col("below") / F.col("total") * 100)
    return df.join(ranked.select("_v", pct.alias("legacy_pct")), "_v", "left").drop("_v")


def break_table(values: DataFrame, zeros: DataFrame | None = None, steps: int = 100) -> DataFrame:
    """``(step, value)`` for p0..p100: the value at position ``round(last * step / steps)``.

    ``values`` has one ``value`` column. ``zeros`` has one row with ``missing``: that many zeros
    join the population (cells of the zone that carry no row).
    """
    hist = values.groupBy("value").agg(F.count("*").alias("n"))
    if zeros is not None:
        extra = zeros.where("missing > 0").select(
            F.lit(0).cast("double").alias("value"), F.col("missing").cast("long").alias("n")
        )
        hist = (
            hist.select(F.col("value").cast("double"), "n")
            .unionByName(extra)
            .groupBy("value")
            .agg(F.sum("n").alias("n"))
        )
    ranked = running_count(hist, "value", "n")
    every = F.sequence(F.lit(0), F.lit(steps))
    last = (F.col("total") - 1).cast("double")
    hit = F.filter(
        every,
        lambda k: (F.rint(last * k / steps) >= F.col("below"))
        & (F.rint(last * k / steps) < F.col("below") + F.col("n")),
    )
    return ranked.select(F.explode(hit).alias("step"), half_even("value", 2).alias("value"))


def breaks(values: DataFrame, zeros: DataFrame | None = None, steps: int = 100) -> list[float]:
    """The break values as a list (``steps + 1`` numbers, whatever the size of the data)."""
    rows = break_table(values, zeros, steps).orderBy("step").collect()
    return [r["value"] for r in rows]


def percentile_of(value: Column | str, cuts: list[float]) -> Column:
    """0..100 by the right-most break that is not above the value.

    At or below the first break gives 0, at or above the last 100.
    """
    value = F.col(value) if isinstance(value, str) else value
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(float(c)) for c in cuts])
    reached = F.size(F.filter(table, lambda c: c <= value)) - 1
    return (
        F.when(value <= cuts[0], F.lit(0)).when(value >= cuts[-1], F.lit(100)).otherwise(reached)
    )
