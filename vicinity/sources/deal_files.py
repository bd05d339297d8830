"""Ministry deal files: free text above the header, differing headers, kind and year in the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Header tokens, row used when no header is found, words of the two kinds, columns.
HEADER_TOKENS = ("시군구", "단지명", "계약년월")
DEFAULT_HEADER_ROW = 13
RENT_WORDS = ("rent", "jeonse", "월세", "전세", "전월세")
TRADE_WORDS = ("trade", "sale", "매매", "실거래")
COLUMNS = {
    "region": ("시군구", "법정동"), "apartment_name": ("단지명", "아파트명"), "road_name": ("도로명", "도로명주소"),
    "lot": ("번지", "지번"), "bonbun": ("본번",), "bubun": ("부번",), "year_month": ("계약년월", "년월"), "day": ("계약일", "일"),
    "area": ("전용면적(㎡)", "전용면적", "전용면적(m2)"), "price": ("거래금액(만원)", "거래금액", "매매금액"),
    "deposit": ("보증금(만원)", "보증금", "보증금액"), "monthly": ("월세금(만원)", "월세금", "월세"), "floor": ("층",),
    "built": ("건축년도", "건축연도"), "housing_type": ("주택유형", "건물용도"),
}


def read_deals(spark: SparkSession, path: str) -> DataFrame:
    """Raw text columns for ``deals.normalise`` from all files under ``path``.

    Lines are numbered by the offset of their split and their place in it, so files are read in
    parallel. The header is the first line with all tokens, else line 13. Cells are paired with
    their own file's header.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.regexp_replace("value", "^﻿", "").alias("value"),
    )
    # a line has at most as many cells as commas and one
    widest = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    cells = F.from_csv("value", F.lit(", ".join(f"c{k} string" for k in range(widest))))
    lines = lines.withColumn("cells", F.array(*[cells[f"c{k}"] for k in range(widest)]))
    folded = F.transform("cells", lambda c: F.regexp_replace(F.coalesce(tx.clean(c), F.lit("")), r"\s+", ""))
    is_header = F.lit(True)
    for token in HEADER_TOKENS:
        is_header = is_header & F.array_contains(folded, token)
    found = lines.where(is_header).groupBy("file").agg(F.min_by(F.struct("at", folded.alias("names")), "at").alias("h"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    fallback = (
        lines.withColumn("place", place).where(F.col("place") <= DEFAULT_HEADER_ROW)
        .where(F.col("place") == DEFAULT_HEADER_ROW)
        .select("file", F.struct("at", folded.alias("names")).alias("d"))
    )
    heads = found.join(fallback, "file", "full_outer").select("file", F.coalesce("h", "d").alias("h"))
    filled = F.exists("cells", lambda c: tx.clean(c).isNotNull())
    rows = lines.join(heads, "file").where((F.col("at") > F.col("h.at")) & filled)
    width = F.size(F.filter("h.names", lambda n: n != ""))
    pairs = F.filter(F.arrays_zip(F.col("h.names").alias("k"), F.col("cells").alias("v")), lambda p: p["k"] != "")
    record = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    rows = rows.where(width > 0).select("name", F.col("h.names").alias("names"), record.alias("r"))
    number = F.upper(F.coalesce(F.try_element_at("r", F.lit("NO")), F.lit("")))
    kept = rows.where(F.trim(number) != "NO")
    return kept.select(
        *[lookup("r", *aliases).alias(column) for column, aliases in COLUMNS.items()],
        deal_kind("name", F.array_join("names", " ")).alias("transaction_type"),
        F.col("name").alias("source_file"),
        source_year("name", lookup("r", "계약년월")).alias("source_year"),
    )


def lookup(record: str, *aliases: str) -> Column:
    """First non-empty value under one of the names, then under a header that contains one."""
    exact = [tx.clean(F.try_element_at(record, F.lit(a))) for a in aliases]
    similar = []
    for a in aliases:
        hits = F.filter(F.map_entries(record), lambda e, a=a: F.contains(e["key"], F.lit(a)) & tx.clean(e["value"]).isNotNull())
        similar.append(tx.clean(F.get(hits, F.lit(0))["value"]))
    return F.coalesce(*exact, *similar)


def deal_kind(file_name: Column | str, header: Column) -> Column:
    """``rent`` or ``trade`` by the words in the file name, else by the header."""
    name = F.lower(F.col(file_name) if isinstance(file_name, str) else file_name)
    has = lambda text, words: F.greatest(*[F.contains(text, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(text, F.lit(words[0]))
    return (
        F.when(has(name, RENT_WORDS), "rent").when(has(name, TRADE_WORDS), "trade")
        .when(has(header, ("보증금", "월세")), "rent").otherwise("trade")
    )


def source_year(file_name: str, year_month: Column) -> Column:
    """The year in the file name, else the first four digits of the contract month."""
    named = F.nullif(F.regexp_extract(file_name, "(20[0-9]{2})", 1), F.lit(""))
    return F.coalesce(named, F.substring(year_month, 1, 4))
