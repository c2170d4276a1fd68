"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import exact_dedup, mixing, near_copies, packing, quality_rules
from meterline.llm.common import dropped, saved, table
from meterline.llm.queries import word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule of the current policy."""
    return quality_rules.passed(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one of largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (SimHash, verified on five-word shingles): the one of smallest id."""
    return near_copies.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, once for each epoch that takes words of them."""
    return mixing.in_epochs(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Tokens are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages are deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = saved(stage(spark, docs, sf_dir), "stage")
        if k:
            dropped(docs)
        docs = made
    return docs
