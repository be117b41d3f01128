"""A training corpus from documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept. All but the last return the columns of documents; the last returns a
row for each document with its shard and slot in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from corpuslens.llm.common import cut, table

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base check or the learned rules reject."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by sets of five-word n-grams of a similarity of 0.8 or more."""
    return ngram_join.drop_similar(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents so often that its words come to its target."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document, repeats too, in one of the shards."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("source_mixture", mixture), ("sharding", shards)]

#: The stages learn from labels and search for a balanced sample, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
