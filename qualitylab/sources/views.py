"""Logical views over the shared test tables: responses, annotations, predictions, prompts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitylab.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, on all cores: text work is heavy for its size."""
    return spread(table(spark, folder, name).select(*columns))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as responses; the source is the category, its name the prompt."""
    return texts(spark, folder, "documents", "doc_id", "text", "source", "lang").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", F.lit("Describe"), "source", F.lit("in"), "lang").alias("prompt"),
        F.col("text").alias("response"),
        F.col("source").alias("category"),
        F.col("lang").alias("language"),
    )


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation labels; about 60 % of the documents have none."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        (1 + 4 * F.col("quality")).cast("double").alias("clarity_score"),
        (5 - 4 * F.col("toxic")).cast("double").alias("safety_score"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions ``(id, y_true, y_pred, y_pred_b, category, difficulty, prompt)`` from events.

    The predictions are group means: per user and type, and per type. Means are
    aggregated and joined back rather than windowed, so a hot group is not one task.
    """
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (1 + 4 * F.least("value", F.lit(200.0)) / 200).alias("y_true"),
        F.col("event_type").alias("category"),
        "user_id",
        F.col("props").alias("prompt"),
    )
    fine = events.groupBy("user_id", "category").agg(F.round(F.avg("y_true"), 9).alias("y_pred"))
    coarse = events.groupBy("category").agg(F.round(F.avg("y_true"), 9).alias("y_pred_b"))
    return (
        events.join(fine, ["user_id", "category"])
        .join(coarse, "category")
        .select(
            "id", "y_true", "y_pred", "y_pred_b", "category",
            F.concat(F.lit("g"), F.col("user_id") % 10).alias("difficulty"), "prompt",
        )
    )


def three_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scored answers: three scores in [1, 5], a category and a strategy."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        key.alias("id"),
        F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("strategy"),
        F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("prompt_id"),
        (1 + (price % 4000) / 1000).alias("humanity_score"),
        (1 + (key % 401) / 100).alias("performance_score"),
        (1 + ((price * 7) % 4000) / 1000).alias("helpfulness_score"),
        F.col("o_orderdate").alias("timestamp"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and response pairs: an assistant turn joined to the user turn before it.

    A join on (conversation, turn) rather than ``lead``: one conversation may be huge.
    """
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"])


# The same views for DuckDB, as WITH clauses for the oracles.
SCORED_SQL = """
ev AS (SELECT event_id AS id, 1 + 4 * least(value, 200.0) / 200 AS y_true,
              event_type AS category, user_id, props AS prompt FROM events),
fine AS (SELECT user_id, category, round(avg(y_true), 9) AS y_pred FROM ev GROUP BY ALL),
coarse AS (SELECT category, round(avg(y_true), 9) AS y_pred_b FROM ev GROUP BY ALL),
scored AS (SELECT id, y_true, y_pred, y_pred_b, category,
                  'g' || (user_id % 10) AS difficulty, prompt
           FROM ev JOIN fine USING (user_id, category) JOIN coarse USING (category))
"""
SCORES_SQL = """
s3 AS (SELECT o_orderkey AS id, o_orderpriority AS category, 'c' || (o_custkey % 5) AS strategy,
              'p' || (o_custkey % 7) AS prompt_id,
              1 + (o_totalprice % 4000) / 1000 AS humanity_score,
              1 + (o_orderkey % 401) / 100 AS performance_score,
              1 + ((o_totalprice * 7) % 4000) / 1000 AS helpfulness_score,
              o_orderdate AS "timestamp" FROM orders),
comp AS (SELECT *, humanity_score * 0.35 + performance_score * 0.25
                   + helpfulness_score * 0.40 AS composite_score FROM s3)
"""
RESPONSES_SQL = """
resp AS (SELECT doc_id AS id, 'Describe ' || source || ' in ' || lang AS prompt, text AS response,
                source AS category, lang AS language FROM documents)
"""
PAIRS_SQL = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
          FROM conversations u JOIN conversations a
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')
"""
