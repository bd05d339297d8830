"""Looking sites and schools up by name, prefix search and option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_search
from ..session import spread


def resolve_site(
    sites: DataFrame, name: str, gu: str | None = None, dong: str | None = None, order: str = "site_id"
) -> DataFrame:
    """The one site a free-text name means.

    An exact name beats containment; district, then neighbourhood narrow the candidates only
    when they leave some. One ordered top row says all of that.
    """
    hits = sites.where(F.contains("name", F.lit(name)))
    wanted = {"name": name, "gu": gu, "dong": dong}
    misses = [F.coalesce(F.col(column) != value, F.lit(True)) for column, value in wanted.items() if value]
    return hits.orderBy(*misses, order).limit(1)


def lookup_site(
    rows: DataFrame, name: str, gu: str | None = None, dong: str | None = None, order: str = "ord"
) -> DataFrame:
    """Keyed lookup: with the full key the last row wins, by name alone the first."""
    hits = rows.where(F.col("name") == name)
    if gu is None:
        return hits.orderBy(order).limit(1)
    return hits.where((F.col("gu") == gu) & (F.col("dong") == dong)).orderBy(F.desc(order)).limit(1)


def serving_table(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row per ``(name, gu, dong)``: the last one."""
    keep = [c for c in rows.columns if c not in ("name", "gu", "dong")]
    last = F.max_by(F.struct(*keep), order).alias("_last")
    return rows.groupBy("name", "gu", "dong").agg(last).select("name", "gu", "dong", "_last.*")


def substrings(text: Column, shortest: Column | int = 1) -> Column:
    """All distinct substrings of at least ``shortest`` characters."""
    n = F.length(text)
    low = F.lit(shortest) if isinstance(shortest, int) else shortest
    starts = F.when(n >= low, F.sequence(F.lit(1), n - low + 1))
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda s: F.transform(
                    F.sequence(low, n - s + 1), lambda size: F.substring(text, s, size)
                ),
            )
        )
    )


def containment_join(
    left: DataFrame, right: DataFrame, left_text: str, right_text: str, keys: tuple[str, ...] = (), shortest: int = 1
) -> DataFrame:
    """Pairs (inside equal ``keys``) where one text contains the other.

    Names are short, so the containing side is taken apart into its substrings and joined by equality: work grows with
    matches, not with the pairs of a block. Distinct texts meet by the hashes of their parts, two numbers a part; the
    texts themselves are compared when the rows are joined back, so a hash that two texts share adds nothing.
    """
    names = lambda df, text: spread(df.where(F.length(text) >= shortest).select(*keys, text).distinct())
    whole = lambda df, text, name: df.select(F.xxhash64(*keys, text).alias(name)).distinct()

    def parts(df: DataFrame, text: str, name: str, part: str) -> DataFrame:
        hashes = F.transform(substrings(F.col(text), shortest), lambda x: F.xxhash64(*keys, x))
        return spread(df.select(F.xxhash64(*keys, text).alias(name), F.explode(hashes).alias(part)))

    a, b = names(left, left_text), names(right, right_text)
    down = parts(a, left_text, "_l", "_r").join(whole(b, right_text, "_r"), "_r", "left_semi")
    up = parts(b, right_text, "_r", "_l").join(whole(a, left_text, "_l"), "_l", "left_semi")
    pairs = spread(down.select("_l", "_r").unionByName(up.select("_l", "_r")).distinct())
    held = right.withColumn("_r", F.xxhash64(*keys, right_text)).withColumnsRenamed({k: f"_{k}" for k in keys})
    found = spread(left).withColumn("_l", F.xxhash64(*keys, left_text)).join(pairs, "_l").join(spread(held), "_r")
    same = F.contains(left_text, right_text) | F.contains(right_text, left_text)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return found.where(same).drop("_l", "_r", *[f"_{k}" for k in keys])


def resolve_school(zones: DataFrame, schools: DataFrame) -> DataFrame:
    """The school of each zone name: an exact match, else one name inside the other.

    ``zones``: ``zone``; ``schools``: ``school``. Ties: the smallest school name.
    """
    pairs = containment_join(zones, schools, "zone", "school", shortest=2)
    best = F.min(F.struct((F.col("zone") != F.col("school")).cast("int").alias("miss"), "school"))
    return pairs.groupBy("zone").agg(best.alias("_b")).select(
        "zone", F.col("_b.school").alias("school"), (F.col("_b.miss") == 0).alias("exact")
    )


def search_sites(sites: DataFrame, text: str, limit: int = 12, order: str = "site_id") -> DataFrame:
    """Sites whose name, district and neighbourhood contain the text; names that start with it first."""
    wanted = text.replace(" ", "").lower()
    all_text = normalize_search(F.concat_ws(" ", "name", "gu", "dong"))
    starts = normalize_search("name").startswith(wanted)
    hits = sites.where(F.contains(all_text, F.lit(wanted)))
    return hits.withColumn("starts", starts).orderBy(F.desc("starts"), order).limit(min(limit, 30))


def options(rows: DataFrame, value: str, text: str = "", limit: int = 30) -> DataFrame:
    """Distinct values for a picker: prefix hits first, then containment, capped."""
    wanted = text.replace(" ", "").lower()
    values = rows.select(F.col(value).alias("value")).where(F.col(value).isNotNull()).distinct()
    if wanted:
        values = values.where(F.contains(normalize_search("value"), F.lit(wanted)))
    starts = normalize_search("value").startswith(wanted)
    return values.withColumn("starts", starts).orderBy(F.desc("starts"), "value").limit(limit)


def line_stations(stations: DataFrame) -> DataFrame:
    """Line -> sorted station names (the word for "station" dropped)."""
    name = F.replace("name", F.lit("역"), F.lit(""))
    return (
        stations.select(F.explode("lines").alias("line"), name.alias("station"))
        .where("line <> '' AND station <> ''")
        .distinct()
    )


def stations_of_line(index: DataFrame, line: str, limit: int = 30) -> DataFrame:
    """Stations of a line and of lines whose name extends it, or is extended by it."""
    related = F.col("line").startswith(line) | F.startswith(F.lit(line), F.col("line"))
    return index.where(related).select("station").distinct().orderBy("station").limit(limit)


def values_by_type(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Distinct values of every type, numbered in order (option lists by type)."""
    order = Window.partitionBy(kind).orderBy(value)
    return rows.select(kind, value).distinct().withColumn("place", F.row_number().over(order))
