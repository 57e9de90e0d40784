"""From raw documents to placed training text: five stages, each of them one operator of ``qualitylab.llm``.

Every stage gets the documents that the one before it kept, as a Parquet table, and its decisions take effect:
all but the last return documents with the columns that they came with. The last places them in shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qualitylab.llm import classifier, decontaminate, jaccard, mixing, sharding
from qualitylab.llm.shared import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, accepts."""
    return classifier.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates: five words, similarity 0.8."""
    return jaccard.one_of_each(docs, percent=80, shingle=5)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def placed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.sharded(docs, shards=8)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", clean_of_benchmark),
    ("source_mixing", mixed_documents),
    ("sharding", placed_documents),
]

#: The classifier is trained, which SQL cannot express; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
