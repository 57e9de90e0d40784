"""Label joins, prompt and strategy tables, and rule checks.

No join here carries a broadcast hint: Spark broadcasts a side when its size is under
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges (with AQE skew splits) otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitylab.functions import fixed, scores


def merge_labels(
    df: DataFrame, labels: DataFrame, columns: Sequence[str] | None = None, key: str = "id"
) -> DataFrame:
    """Left-join the wished label columns that exist."""
    wished = fixed.ANNOTATION_COLUMNS if columns is None else columns
    return df.join(labels.select(key, *scores.available(labels, wished)), key, "left")


def merged_dataset(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows with labels and the composite target."""
    return scores.with_composite(merge_labels(df, labels))


def answers_to_prompts(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses with the prompt their foreign key names."""
    asked = prompts.withColumnRenamed("id", "prompt_id")
    return responses.withColumnRenamed("id", "response_id").join(asked, "prompt_id")


def without(df: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken``."""
    return df.join(taken.select(key), key, "left_anti")


def with_strategies(
    prompts: DataFrame, prompt: str = "prompt", strategies=tuple(fixed.PROMPT_STRATEGIES)
) -> DataFrame:
    """Each prompt under each strategy: an exploded literal, so no join at all."""
    options = F.array(*[
        F.struct(
            F.lit(name).alias("strategy"), F.lit(system).alias("system_prompt"),
            F.lit(template).alias("template"),
        )
        for name, system, template, _ in strategies
    ])
    return prompts.select("*", F.inline(options)).withColumn(
        "full_prompt", F.replace(F.col("template"), F.lit("{prompt}"), F.col(prompt))
    ).drop("template")


def strategy_table(spark: SparkSession, strategies=tuple(fixed.PROMPT_STRATEGIES)) -> DataFrame:
    return spark.createDataFrame(
        [tuple(s) for s in strategies],
        "strategy string, system_prompt string, user_template string, description string",
    )


def enhanced_prompt(column: str = "prompt", suffix: str = fixed.ENHANCED_PROMPT_SUFFIX):
    return F.concat(F.col(column), F.lit(suffix))


def submission(df: DataFrame, system_prompt: str = fixed.SUBMISSION_SYSTEM_PROMPT) -> DataFrame:
    """Submission rows with an empty response and no score yet."""
    return df.select(
        *scores.available(df, ["id", "prompt", "category", "difficulty"]),
        F.lit(system_prompt).alias("system_prompt"),
        enhanced_prompt().alias("enhanced_prompt"),
        F.lit("").alias("response"),
        F.lit(None).cast("double").alias("predicted_composite_score"),
    )


def response_record(df: DataFrame, model_name: str) -> DataFrame:
    """Prompt, response, strategy, time and token count in the response record's shape."""
    from qualitylab.functions import text

    return df.select(
        "prompt", "response", "strategy",
        F.col("response_time_ms").cast("double").alias("response_time_ms")
        if "response_time_ms" in df.columns else F.lit(0.0).alias("response_time_ms"),
        text.token_count(F.col("response")).alias("token_count"),
        F.lit(model_name).alias("model_name"),
    )


def check_rules(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """Violations of a data dictionary as ``(column, rule, violations)``, from one scan.

    A field's rules are ``nullable``, ``allowed_values``, ``range`` and ``max_length``.
    """
    counts = []
    for name, rule in rules.items():
        column = F.col(name)
        broken = {}
        if rule.get("nullable") is False:
            broken["not_null"] = column.isNull()
        if "allowed_values" in rule:
            broken["allowed_values"] = ~column.isin(list(rule["allowed_values"]))
        if "range" in rule:
            low, high = rule["range"]
            broken["range"] = ~column.between(low, high)
        if "max_length" in rule:
            broken["max_length"] = F.char_length(column) > rule["max_length"]
        counts += [
            F.struct(F.lit(name).alias("column"), F.lit(label).alias("rule"),
                     F.count_if(bad).alias("violations"))
            for label, bad in broken.items()
        ]
    return df.agg(F.array(*counts).alias("checks")).select(F.inline("checks"))


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by name; a column that one side lacks is null there."""
    return first.unionByName(second, allowMissingColumns=True)
