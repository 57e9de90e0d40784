"""Exploratory summaries. Each is one aggregation unless it needs exact quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.functions.stats import correlation
from qualitylab.operators import ordering
from qualitylab.session import pin


def group_summary(
    df: DataFrame, group: str, means: Mapping[str, str], spreads: Mapping[str, str] | None = None,
    sort_by: str | None = None, digits: int = 3, count: str | None = "count",
) -> DataFrame:
    """Count, means and sample deviations per group, rounded and sorted.

    ``means`` and ``spreads`` map an output name to a column.
    """
    columns: list[Column] = [F.count(F.lit(1)).alias(count)] if count else []
    columns += [F.round(F.avg(c), digits).alias(name) for name, c in means.items()]
    columns += [
        F.round(F.stddev_samp(c), digits).alias(name) for name, c in (spreads or {}).items()
    ]
    out = df.groupBy(group).agg(*columns)
    return out.orderBy(F.desc(sort_by), group) if sort_by else out


def pivot_means(
    df: DataFrame, rows: str, columns: str, value: str, names: Sequence[str], digits: int = 2
) -> DataFrame:
    """Mean of ``value`` for each row key and named column key."""
    wide = df.groupBy(rows).pivot(columns, list(names)).agg(F.avg(value))
    return wide.select(rows, *[F.round(F.col(n), digits).alias(n) for n in names])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column)


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]
    return df.select(*keep, F.inline(F.array(*rows)))


def describe(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per column."""
    long = _long(df, columns)
    basic = long.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    quarters = ordering.exact_quantiles(long, ["column"], "x", [0.25, 0.5, 0.75], "q")
    wide = basic.join(quarters, "column", "left").select(
        "column", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max",
    )
    return wide.select(
        "column", "count", *[F.round(c, digits).alias(c) for c in wide.columns[2:]]
    )


def target_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )


def group_versus_all(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Group means beside the overall means (a one-row scalar subquery)."""
    overall = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])
    return means.withColumn("_all", overall).select(
        group, *[f"avg_{c}" for c in columns],
        *[F.col(f"_all.{c}").alias(f"overall_{c}") for c in columns],
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, both ways round, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(
        F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r"))
            for a, b in pairs
        ]).alias("cells")
    )
    cells = row.select(F.inline("cells"))
    mirrored = cells.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return cells.unionByName(mirrored)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the last is closed, empty bins are listed with 0."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    number = F.lit(0)
    for i in range(1, bins):
        number = F.when(F.col(column) >= edges[i], i).otherwise(number)
    counts = df.where(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    frame = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, low double, high double"
    )
    return frame.join(counts, "bin", "left").select(
        "bin", "low", "high", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def box_plot(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR and the number of outliers per group.

    The rows are read, counted and sorted once; what meets the quartiles again are the counted values, not the rows.
    """
    counts = pin(ordering.counted(df, [group], column))
    quartiles = ordering.quantiles_of(counts, [group], column, [0.25, 0.5, 0.75], "q").select(
        group, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "med", "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return counts.select(group, column, "n").join(quartiles, group).groupBy(group, "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label and the share's distance from an even split."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    whole = counts.agg(
        F.struct(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("labels"))
    ).scalar()
    share = F.col("rows") / F.col("_w.rows")
    return counts.withColumn("_w", whole).select(
        label, "rows", share.alias("share"), F.abs(share - 1 / F.col("_w.labels")).alias("deviation")
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column from one aggregation."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column", "nulls")


def fill_with_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the exact column median; all medians come from one sort."""
    medians = ordering.exact_median(_long(df, columns), ["column"], "x", "m")
    values = {row["column"]: row["m"] for row in medians.collect()}  # one row per column
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c)).cast("double")) for c in columns}
    )


def top_keywords(
    df: DataFrame, words: Column, stop_words: Sequence[str], top_n: int = 30
) -> DataFrame:
    """Most frequent words of an array column; ties in alphabetical order."""
    counts = (
        df.select(F.explode(words).alias("word"))
        .where(~F.col("word").isin(list(stop_words)))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return ordering.top(counts, top_n, F.desc("count"), "word")
