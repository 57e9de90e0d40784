"""Flagship report: text quality by language over all documents and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylab.functions import features, text
from qualitylab.operators import joins


def quality_by_language(responses: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows, labelled rows, mean text features and mean clarity per language."""
    merged = joins.merge_labels(responses, annotations, ["clarity_score"])
    described = features.with_text_features(merged).withColumn(
        "clean_length", F.char_length(text.clean(F.col("response")))
    )
    mean = lambda c: F.round(F.avg(c), 4).alias(f"avg_{c}")
    return described.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.count("clarity_score").alias("labelled"),
        mean("clean_length"), mean("response_length"), mean("response_word_count"),
        mean("sentence_count"), mean("lexical_diversity"), mean("has_list"), mean("has_number"),
        mean("clarity_score"),
    ).orderBy("language")
