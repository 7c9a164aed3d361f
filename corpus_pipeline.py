"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``; the last adds n_tokens, block and place, which order the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontam, exact_dedup, mixing, similar_sets, toxicity
from framewright.llm.common import stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(spark, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash brings together, or the exact search for what it misses, one stays; five-word shingles alike to 0.8 or more decide each link."""
    return similar_sets.keep_one(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.keep_clean(spark, docs, sf_dir)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are dealt by tempered weights, each document once a block."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", clean), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", unleaked), ("mixing", mixed)]

#: Boosted trees, fingerprints and tilings can't be expressed in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
