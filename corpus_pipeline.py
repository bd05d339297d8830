"""Stages that turn ``documents`` into clean, tokenised training rows.

Every stage works on all rows that its predecessor kept, written as Parquet and read again. All but the last return
the columns of ``documents``; the last one returns each remaining document with its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import bpe, decontaminate, exact, ngram_join, toxicity
from vicinity.llm.common import cut, release, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Alignment and tokens can't be said in SQL; tests hold the stages and their operators against plain versions.
ORACLE_SQL = None

#: Near duplicates: words in a shingle, and the similarity in percent.
SHINGLE, SIMILAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Learns from the labelled rows among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest id stays."""
    return exact.drop_copies(docs)


def _row_key(docs: DataFrame) -> Column:
    """Stands for a row by id and text (64 bits), so that rows without id, or that share one, are told apart."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates, the smallest id stays; texts without words stay all.

    A missing id sorts first. Rows without id, and rows that share an id, are documents of their own by their texts.
    """
    keyed = docs.select(_row_key(docs).alias("key"), F.col("doc_id").alias("id"), "text")
    groups = ngram_join.jaccard_components(keyed, id_col="key", size=SHINGLE, percent=SIMILAR).select("key", "component_id")
    first = F.min_by("key", F.struct("id", "key")).alias("stays")
    stay = groups.join(keyed.select("key", "id"), "key").groupBy("component_id").agg(first).select("stays")
    return docs.join(stay, _row_key(docs) == stay["stays"], "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, whole or edited, go; others with the same id, or none, stay."""
    keyed = docs.select(_row_key(docs).alias("key"), "text")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="key").select(F.col("key").alias("found")).distinct()
    return docs.join(found, _row_key(docs) == found["found"], "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, token_ids, decoded)`` of every document that is left."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("ngram_jaccard_join", drop_near),
    ("decontamination", drop_contaminated), ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark)
    return docs
