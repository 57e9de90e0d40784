"""Structural text features, one ``Column`` each; null text gives 0 (or 1 for counts of parts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.functions import fixed, text


def _or(value: Column, default: int) -> Column:
    return F.coalesce(value, F.lit(default))


def char_length(column: Column) -> Column:
    return _or(F.char_length(column), 0)


def unique_word_count(column: Column) -> Column:
    return _or(F.size(F.array_distinct(text.split_words(F.lower(column)))), 0)


def sentence_count(column: Column) -> Column:
    """Pieces between runs of ``. ! ?``; an empty last piece counts."""
    return _or(F.greatest(F.size(F.split(column, "[.!?]+", -1)), F.lit(1)), 1)


def mark_count(column: Column, mark: str) -> Column:
    return _or(F.regexp_count(column, F.lit(f"[{mark}]")), 0)


def has_list(column: Column) -> Column:
    return _or(column.rlike(rf"\p{{Nd}}\)|-{text.SPACES}|[*]").cast("int"), 0)


def has_number(column: Column) -> Column:
    return _or(column.rlike(r"\p{Nd}").cast("int"), 0)


def paragraph_count(column: Column) -> Column:
    return _or(F.regexp_count(column, F.lit("\n\n")) + 1, 1)


def avg_word_length(column: Column) -> Column:
    """Mean letters per word; no words give 0."""
    letters = F.char_length(F.regexp_replace(column, text.SPACES + "+", ""))
    return F.coalesce(F.try_divide(letters, F.size(text.split_words(column))), F.lit(0.0))


def per(count: Column, base: Column) -> Column:
    """``count / base`` with a base of 0 taken as 1."""
    return count / F.when(base == 0, 1).otherwise(base)


def with_text_features(
    df: DataFrame,
    response_col: str = "response",
    prompt_col: str = "prompt",
    medical_stems: Sequence[str] = tuple(fixed.MEDICAL_STEMS),
    empathy_stems: Sequence[str] = tuple(fixed.EMPATHY_STEMS),
    notebook_extras: bool = False,
) -> DataFrame:
    """Add the 16 structural features (18 with ``notebook_extras``). One projection, no shuffle."""
    prompt, response = F.col(prompt_col), F.col(response_col)
    # Split once: lower case changes no white space, so the words are as many.
    words = text.let(
        text.split_words(F.lower(response)),
        lambda ws: F.struct(F.size(ws).alias("all"), F.size(F.array_distinct(ws)).alias("unique")),
    )
    counted = {
        "prompt_length": char_length(prompt),
        "response_length": char_length(response),
        "prompt_word_count": text.token_count(prompt),
        "response_word_count": _or(F.col("_words")["all"], 0),
        "sentence_count": sentence_count(response),
        "unique_word_count": _or(F.col("_words")["unique"], 0),
        "question_marks": mark_count(response, "?"),
        "exclamation_marks": mark_count(response, "!"),
        "has_list": has_list(response),
        "has_number": has_number(response),
        "paragraph_count": paragraph_count(response),
        "has_medical_terms": text.contains_stem(response, medical_stems),
        "has_empathy_words": text.contains_stem(response, empathy_stems),
    }
    if notebook_extras:
        counted["avg_word_length"] = avg_word_length(response)
        counted["comma_count"] = mark_count(response, ",")
    ratios = {
        "length_ratio": per(F.col("response_word_count"), F.col("prompt_word_count")),
        "avg_sentence_length": per(F.col("response_word_count"), F.col("sentence_count")),
        "lexical_diversity": per(F.col("unique_word_count"), F.col("response_word_count")),
    }
    return df.withColumn("_words", words).withColumns(counted).drop("_words").withColumns(ratios)


def preprocess(
    df: DataFrame, text_columns: Sequence[str], tokenized_columns: Sequence[str] = (), **token_options
) -> DataFrame:
    """Add ``<c>_clean`` for each text column and ``<c>_tokens`` for those asked for."""
    remove_numbers = token_options.pop("remove_numbers", False)
    cleaned = df.withColumns(
        {f"{name}_clean": text.clean(F.col(name), remove_numbers) for name in text_columns}
    )
    tokens = {
        f"{name}_tokens": text.tokenize(F.col(f"{name}_clean"), **token_options)
        for name in tokenized_columns
        if name in text_columns
    }
    return cleaned.withColumns(tokens) if tokens else cleaned


def preprocess_and_describe(
    df: DataFrame,
    prompt_col: str = "prompt",
    response_col: str = "response",
    include_tokens: bool = True,
    **feature_options,
) -> DataFrame:
    """Clean, tokenise and featurise prompt and response in one projection."""
    both = [prompt_col, response_col]
    ready = preprocess(df, both, both if include_tokens else ())
    return with_text_features(ready, response_col, prompt_col, **feature_options)
