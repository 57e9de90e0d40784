"""Score columns: composite target, clipping, timestamp parts, small row operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.functions import fixed


def composite(weights: Mapping[str, float] = fixed.SCORE_WEIGHTS) -> Column:
    """Weighted sum of the score columns."""
    first, *rest = [F.col(name) * F.lit(weight) for name, weight in weights.items()]
    for term in rest:
        first = first + term
    return first


def with_composite(
    df: DataFrame, weights: Mapping[str, float] = fixed.SCORE_WEIGHTS, name: str = "composite_score"
) -> DataFrame:
    """Add the composite target; ``df`` is left as it is unless every score is there."""
    return df.withColumn(name, composite(weights)) if set(weights) <= set(df.columns) else df


def clip(value: Column, low: float = fixed.SCORE_LOW, high: float = fixed.SCORE_HIGH) -> Column:
    """Bound to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def available(df: DataFrame, wished: Sequence[str]) -> list[str]:
    """Those of ``wished`` that ``df`` has, in wished order."""
    return [name for name in wished if name in df.columns]


def in_categories(df: DataFrame, categories: str | Sequence[str], column: str = "category") -> DataFrame:
    wanted = [categories] if isinstance(categories, str) else list(categories)
    return df.where(F.col(column).isin(wanted))


def split_by_value(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """Rows equal to ``value`` and all others; rows with null go to the others."""
    same = F.col(column).eqNullSafe(F.lit(value))
    return df.where(same), df.where(~same)


def with_time_parts(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Add ``hour`` and ``day_of_week`` (Monday is 0); text is parsed first."""
    stamp = F.col(column)
    if dict(df.dtypes)[column] == "string":
        df = df.withColumn(column, F.try_to_timestamp(stamp))
    return df.withColumns({"hour": F.hour(column), "day_of_week": F.weekday(column)})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, as sources deliver missing values."""
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def excerpt(column: Column, length: int = 100) -> Column:
    return F.substring(column, 1, length)
