"""Regression, ranking, calibration and fairness metrics over ``(id, y_true, y_pred, …)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylab.functions import fixed, scores
from qualitylab.functions.stats import correlation
from qualitylab.operators import ordering

TRUE, PRED = "y_true", "y_pred"
METRICS = [
    "rmse", "mae", "r2", "mape", "medae", "max_error",
    "pearson_r", "spearman_r", "explained_variance",
]


def _residual() -> Column:
    return F.col(TRUE) - F.col(PRED)


# --- one aggregate expression per metric --------------------------------------------
def rmse() -> Column:
    return F.sqrt(F.avg(_residual() * _residual()))


def mae() -> Column:
    return F.avg(F.abs(_residual()))


def r2() -> Column:
    spread = F.var_pop(TRUE) * F.count(TRUE)
    return F.when(spread == 0, 0.0).otherwise(
        1 - F.try_divide(F.sum(_residual() * _residual()), spread)
    )


def mape() -> Column:
    share = F.when(F.col(TRUE) != 0, F.abs(F.try_divide(_residual(), F.col(TRUE))))
    return F.coalesce(F.avg(share) * 100, F.lit(float("inf")))


def max_error() -> Column:
    return F.max(F.abs(_residual()))


def pearson_r() -> Column:
    return correlation(TRUE, PRED)


def explained_variance() -> Column:
    return F.when(F.var_pop(TRUE) > 0, 1 - F.try_divide(F.var_pop(_residual()), F.var_pop(TRUE))).otherwise(0.0)


def within(limit: float) -> Column:
    """Share of rows, in percent, whose absolute error is at most ``limit``."""
    return F.avg((F.abs(_residual()) <= limit).cast("double")) * 100


# --- tables ---------------------------------------------------------------------------
def scoped_metrics(scored: DataFrame, scopes: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """All nine metrics and the row count in every scope (a name and its group columns), one row per group.

    Truth, prediction and absolute error are sorted one after the other, each once for all scopes; a row carries its
    places along, so nothing is joined on a value or a group. Rows whose group is null count in the other scopes only.
    """
    keys = list(dict.fromkeys(c for groups in scopes.values() for c in groups))
    rows = scored.select(*keys, TRUE, PRED).dropna(subset=[TRUE, PRED]).withColumn("_error", F.abs(_residual()))
    for side, column in (("_t", TRUE), ("_p", PRED), ("_e", "_error")):
        rows = ordering.placed(rows, column, scopes, side)
    out = {}
    for scope, groups in scopes.items():
        ranks = {f"{side}_rank": ordering.place_rank(f"{side}{scope}") for side in ("_t", "_p")}
        wide = rows.dropna(subset=list(groups)) if groups else rows
        out[scope] = wide.withColumns(ranks).groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n"), rmse().alias("rmse"), mae().alias("mae"), r2().alias("r2"),
            mape().alias("mape"), ordering.place_median(f"_e{scope}", "_error").alias("medae"),
            max_error().alias("max_error"), pearson_r().alias("pearson_r"),
            correlation("_t_rank", "_p_rank").alias("spearman_r"), explained_variance().alias("explained_variance"),
        )
    return out


def regression_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All nine metrics and the row count, one row per group (one row without ``by``)."""
    return scoped_metrics(scored, {"": by})[""].select(*by, "n", *METRICS)


def tidy(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """Unpivot metric columns to ``(keys…, metric, value)`` rows."""
    rounded = wide.select(
        *keys, *[F.round(F.col(m).cast("double"), digits).alias(m) for m in metrics]
    )
    return rounded.unpivot(list(keys), list(metrics), "metric", "value")


def ranking_alignment(scored: DataFrame, k: int = 10, key: str = "id") -> DataFrame:
    """NDCG@k with linear gain; ties go to the smaller key. Only 2k rows leave the tasks."""

    def gain(order: str) -> DataFrame:
        best = ordering.top(scored.select(key, TRUE, order).dropna(), k, F.desc(order), F.col(key))
        place = F.row_number().over(W.orderBy(F.desc(order), F.col(key)))  # at most k rows
        return best.withColumn("_place", place).agg(
            F.sum(F.col(TRUE) / F.log2(F.col("_place") + 1)).alias("gain")
        )

    found = gain(PRED).scalar()
    return gain(TRUE).select(
        F.when(F.col("gain") > 0, F.try_divide(found, F.col("gain"))).otherwise(0.0).alias("ndcg")
    )


def group_rmse(scored: DataFrame, group: str) -> DataFrame:
    """RMSE of each group of at least two rows."""
    return (
        scored.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), rmse().alias("rmse"))
        .where("n >= 2")
    )


def fairness(scored: DataFrame, group: str) -> DataFrame:
    """Per-group RMSE rows plus the worst group and the gap between groups."""
    per_group = group_rmse(scored, group)
    summary = per_group.agg(
        F.max("rmse").alias("worst_group_rmse"),
        F.coalesce(F.max("rmse") - F.min("rmse"), F.lit(0.0)).alias("rmse_gap"),
    )
    rows = per_group.select(F.col(group).cast("string").alias("name"), F.col("rmse").alias("value"))
    return rows.unionByName(
        summary.unpivot([], ["worst_group_rmse", "rmse_gap"], "name", "value")
    )


def calibration_bins(scored: DataFrame, n_bins: int = 10, include_right: bool = False) -> DataFrame:
    """Equal-width bins on ``y_true``: count, mean truth, mean prediction.

    Bins are half open; rows at the maximum fall in none unless ``include_right``.
    """
    low, high = scored.agg(F.min(TRUE), F.max(TRUE)).first() or (None, None)
    if low is None:
        low = high = 0.0
    step = (high - low) / n_bins
    edges = [low + i * step for i in range(n_bins)] + [high]
    value = F.col(TRUE)
    number = F.lit(None).cast("int")
    for i in range(n_bins):
        last = include_right and i == n_bins - 1
        inside = (value >= edges[i]) & ((value <= edges[i + 1]) if last else (value < edges[i + 1]))
        number = F.when(inside, i).otherwise(number)
    return (
        scored.withColumn("bin", number)
        .where("bin is not null")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(TRUE).alias("avg_true"), F.avg(PRED).alias("avg_pred"))
    )


def calibration_error(scored: DataFrame, n_bins: int = 10, include_right: bool = False) -> DataFrame:
    """Expected calibration error over all rows."""
    rows = scored.agg(F.count(TRUE)).scalar()
    gap = F.abs(F.col("avg_true") - F.col("avg_pred"))
    return calibration_bins(scored, n_bins, include_right).agg(
        F.coalesce(F.sum(F.col("n") * gap / rows), F.lit(0.0)).alias("ece")
    )


def score_bands(
    scored: DataFrame, bands: Sequence[tuple[float, float]] = tuple(fixed.SCORE_BANDS),
    include_right: bool = False,
) -> DataFrame:
    """Error statistics per band ``[low, high)`` of the true score; empty bands drop out."""
    hits = []
    for i, (low, high) in enumerate(bands):
        closed = include_right and i == len(bands) - 1
        inside = (F.col(TRUE) >= low) & (F.col(TRUE) <= high if closed else F.col(TRUE) < high)
        hits.append(F.when(inside, F.lit(f"{low:.0f}-{high:.0f}")))
    errors = F.abs(_residual())
    return (
        scored.withColumn("band", F.explode(F.array_compact(F.array(*hits))))
        .groupBy("band")
        .agg(
            F.round(F.avg(errors), 4).alias("mean_error"),
            F.round(F.stddev_pop(errors), 4).alias("std_error"),
            F.count(F.lit(1)).alias("count"),
            F.round(within(0.5), 2).alias("pct_within_0_5"),
        )
    )


def error_analysis(scored: DataFrame) -> DataFrame:
    residual = _residual()
    return scored.agg(
        F.round(F.avg(residual), 4).alias("mean_residual"),
        F.round(F.stddev_pop(residual), 4).alias("std_residual"),
        F.round(F.max(residual), 4).alias("max_positive_error"),
        F.round(F.min(residual), 4).alias("max_negative_error"),
        F.round(within(0.5), 2).alias("pct_within_0_5"),
        F.round(within(1.0), 2).alias("pct_within_1_0"),
    )


def extreme_predictions(scored: DataFrame, k: int = 5, key: str = "id", prompt: str = "prompt") -> DataFrame:
    """The ``k`` worst and ``k`` best predictions, with the start of their prompt."""
    error = F.abs(_residual())

    def ends(kind: str, order: Column) -> DataFrame:
        return ordering.top(scored.withColumn("_err", error), k, order, F.col(key)).select(
            F.lit(kind).alias("kind"), key, scores.excerpt(F.col(prompt)).alias("prompt"),
            F.round(TRUE, 2).alias("actual"), F.round(PRED, 2).alias("predicted"),
            F.round("_err", 4).alias("error"),
        )

    return ends("worst", F.desc("_err")).unionByName(ends("best", F.asc("_err")))


def residuals(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return scored.select(
        *keep, F.col(TRUE).alias("actual"), F.col(PRED).alias("predicted"),
        _residual().alias("error"), F.abs(_residual()).alias("abs_error"),
    )


def group_breakdown(scored: DataFrame, group: str) -> DataFrame:
    """All nine metrics for each group of at least two rows."""
    return regression_metrics(scored, [group]).where("n >= 2")


def evaluation_report(
    scored: DataFrame, model: str = "model", category: str = "category", difficulty: str = "difficulty"
) -> DataFrame:
    """Whole report as tidy rows ``(model, scope, grp, metric, value)``.

    Global and per-group metrics share their sorts, see ``scoped_metrics``; no row is repeated.
    """
    scopes = {"global": []}
    scopes |= {scope: [column] for scope, column in (("category", category), ("difficulty", difficulty)) if column in scored.columns}
    parts = []
    for scope, wide in scoped_metrics(scored, scopes).items():
        group = F.col(scopes[scope][0]).cast("string") if scopes[scope] else F.lit("all")
        large = wide.where("n >= 2") if scopes[scope] else wide
        named = large.select(F.lit(scope).alias("scope"), group.alias("grp"), "n", *METRICS)
        parts.append(tidy(named, ["scope", "grp"], ["n", *METRICS]))
    errors = error_analysis(scored)
    parts.append(errors.select(F.lit("errors").alias("scope"), F.lit("all").alias("grp"), "*").unpivot(
        ["scope", "grp"], errors.columns, "metric", "value"
    ))
    return reduce(DataFrame.unionByName, parts).select(F.lit(model).alias("model"), "scope", "grp", "metric", "value")
