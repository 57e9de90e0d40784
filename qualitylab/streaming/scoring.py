"""Scoring rows as they arrive. Cleaning and features are stateless expressions, so they
apply to a streaming frame as they are; a fitted model scores each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from qualitylab.functions import features


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def describe_stream(rows: DataFrame, **options) -> DataFrame:
    """Clean columns and text features of a stream: no state, no shuffle."""
    return features.preprocess_and_describe(rows, include_tokens=False, **options)


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, exactly once; ends when the files at hand are done."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start(out)


def score_stream(rows: DataFrame, model, out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch with a fitted model. A batch that is run again after a failure
    overwrites its own folder, so no row is written twice."""

    def score(batch: DataFrame, number: int) -> None:
        model.predict(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
