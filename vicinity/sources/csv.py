"""Text tables: encodings tried in order, raw or typed cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Encodings in the order they are tried.
ENCODINGS = ("UTF-8", "MS949", "EUC-KR")
_REPLACED = "�"


def pick_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding that decodes every line.

    Spark replaces bad bytes instead of failing, so a line with the replacement character rules
    an encoding out; the search runs in parallel and stops at the first such line.
    """
    for encoding in encodings[:-1]:
        with _any_charset(spark):
            lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x01").csv(path)
            if lines.where(F.contains(F.col(lines.columns[0]), F.lit(_REPLACED))).limit(1).isEmpty():
                return encoding
    return encodings[-1]


class _any_charset:
    """Lets Spark use the Korean charsets while a table is read."""

    KEY = "spark.sql.legacy.javaCharsets"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


def read_csv_raw(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Every cell as text, so that leading zeros stay. Korean charsets need the session setting
    ``spark.sql.legacy.javaCharsets=true`` while the result is evaluated."""
    encoding = pick_encoding(spark, path, encodings)
    if encoding != "UTF-8":
        spark.conf.set(_any_charset.KEY, "true")
    rows = spark.read.option("encoding", encoding).option("header", True).option("inferSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in rows.columns]
    return rows.toDF(*names)


def typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Lenient typing of text cells: blanks and null tokens are NULL, so are unreadable numbers."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    out = []
    for f in fields:
        name = tx.alias_of(df.columns, f.name)
        if name is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        kind = f.dataType.typeName()
        cell = F.col(f"`{name}`")
        if kind in ("integer", "long"):
            value = tx.whole(cell).cast(f.dataType)
        elif kind in ("double", "float"):
            value = tx.number(cell).cast(f.dataType)
        elif kind == "string":
            value = tx.clean(cell)
        else:
            value = tx.clean(cell).try_cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)


def read_csv_any(spark: SparkSession, path: str, schema: T.StructType | str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    return typed(read_csv_raw(spark, path, encodings), schema)
