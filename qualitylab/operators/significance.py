"""Paired and independent significance tests; a test statistic needs one aggregation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from qualitylab.operators import ordering


#: Degrees of freedom from which the normal tail, with the first terms in 1/df, is exact to all printed digits,
#: while the beta function's logarithms begin to cancel.
LARGE_DF = 1e6


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            return value
    raise ArithmeticError(f"the beta function's fraction has not settled for {a}, {b}, {x}")


def student_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return None
    if df > LARGE_DF:
        z = t * (1 - 1 / (4 * df)) / math.sqrt(1 + t * t / (2 * df))
        return math.erfc(abs(z) / math.sqrt(2))
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p-value of the signed-rank statistic for ``n`` untied differences."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    def one(stat, rows, tie, zero):
        if stat is None or math.isnan(stat) or not rows:
            return None
        if rows <= 50 and tie == 0 and zero == 0:
            return signed_rank_exact(stat, int(rows))
        spread = math.sqrt((rows * (rows + 1) * (2 * rows + 1) - tie / 2) / 24)
        return math.erfc(abs(stat - rows * (rows + 1) / 4) / spread / math.sqrt(2)) if spread else None

    return pd.Series([one(*row) for row in zip(w, n, ties, zeros)], dtype="float64")


def _error_difference(scored: DataFrame, a: str, b: str) -> DataFrame:
    truth = F.col("y_true")
    return scored.select((F.abs(truth - F.col(a)) - F.abs(truth - F.col(b))).alias("d")).dropna()


def paired_ttest(scored: DataFrame, a: str = "y_pred", b: str = "y_pred_b") -> DataFrame:
    """Paired t-test on absolute errors of two models: ``(n, t_statistic, p_value)``."""
    stats = _error_difference(scored, a, b).agg(
        F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")
    )
    t = F.try_divide(F.col("m"), F.col("s") / F.sqrt(F.col("n")))
    return stats.withColumn("t", t).select(
        "n", F.round("t", 4).alias("t_statistic"),
        F.round(student_p(F.col("t"), (F.col("n") - 1).cast("double")), 6).alias("p_value"),
    )


def wilcoxon(scored: DataFrame, a: str = "y_pred", b: str = "y_pred_b") -> DataFrame:
    """Signed-rank test on absolute errors: ``(n, statistic, p_value)``; zero differences drop out."""
    gaps = _error_difference(scored, a, b)
    sized = gaps.where("d <> 0").withColumn("gap", F.abs("d"))
    signs = sized.groupBy("gap").agg(F.count_if(F.col("d") > 0).alias("up"))
    ranks = ordering.average_ranks(sized, [], "gap").join(signs, "gap")
    zeros = gaps.agg(F.count_if(F.col("d") == 0)).scalar()
    n = F.col("n").cast("double")  # its cube leaves the integers
    sums = ranks.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("avg_rank") * F.col("up")).alias("w_up"),
        F.sum(F.col("avg_rank") * (n - F.col("up"))).alias("w_down"),
        F.sum(n * n * n - n).alias("ties"),
    ).withColumns({"w": F.least("w_up", "w_down"), "zeros": zeros})
    p = signed_rank_p("w", F.col("rows").cast("double"), "ties", F.col("zeros").cast("double"))
    return sums.select(
        F.col("rows").alias("n"), F.round("w", 4).alias("statistic"), F.round(p, 6).alias("p_value")
    )


def pairwise_ttests(
    df: DataFrame, group: str = "strategy", value: str = "composite_score", alpha: float = 0.05
) -> DataFrame:
    """Pooled two-sample t-test for every unordered pair of groups.

    Only the per-group sums are paired (by ``a < b``); the rows are read once.
    """
    sums = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    ).where("n > 0")
    a, b = sums.alias("a"), sums.alias("b")
    pairs = a.join(b, F.col(f"a.{group}") < F.col(f"b.{group}")).select(
        F.col(f"a.{group}").alias("strategy_a"), F.col(f"b.{group}").alias("strategy_b"),
        (F.col("a.m") - F.col("b.m")).alias("diff"),
        (F.col("a.n") + F.col("b.n") - 2).cast("double").alias("df"),
        ((F.col("a.n") - 1) * F.coalesce("a.v", F.lit(0.0))
         + (F.col("b.n") - 1) * F.coalesce("b.v", F.lit(0.0))).alias("ss"),
        (1 / F.col("a.n") + 1 / F.col("b.n")).alias("inv"),
    )
    t = F.try_divide(F.col("diff"), F.sqrt(F.try_divide(F.col("ss"), F.col("df")) * F.col("inv")))
    tested = pairs.withColumn("t", t).withColumn("p", student_p("t", "df"))
    return tested.select(
        "strategy_a", "strategy_b", F.round("diff", 3).alias("mean_diff"),
        F.round("t", 3).alias("t_statistic"), F.round("p", 4).alias("p_value"),
        F.when(F.col("p") < alpha, "Yes").otherwise("No").alias("significant"),
    )
