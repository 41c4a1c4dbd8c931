"""A corpus made ready for training: quality rules, exact and near dedup, mixing to weights, packing.

Each stage reads all that its predecessor kept. The result has one row per packed piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicebox.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from sluicebox.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that recur across their host."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.unique_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (shingles of five words, similarity 0.8), the row with the smallest doc_id."""
    return near_dedup.distinct_documents(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their domain, language and source take them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of equal capacity."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]

#: Best-fit packing and the choice of bins cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
