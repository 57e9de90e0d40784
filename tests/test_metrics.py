import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualitylab.operators import eda, metrics, ordering, significance


def scored(spark, pairs, extra=""):
    rows = [(i, *p) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "id int, y_true double, y_pred double" + extra)


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        out[x == v] = out[x == v].mean()
    return out


def test_nine_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.round(rng.uniform(1, 5, 300), 1)
    p = np.round(t + rng.normal(0, 0.5, 300), 1)
    row = metrics.regression_metrics(scored(spark, list(zip(t.tolist(), p.tolist()))).repartition(5)).first()
    e = t - p
    want = {
        "rmse": np.sqrt((e**2).mean()), "mae": abs(e).mean(), "r2": 1 - (e**2).sum() / ((t - t.mean()) ** 2).sum(),
        "mape": abs(e / t).mean() * 100, "medae": np.median(abs(e)), "max_error": abs(e).max(),
        "pearson_r": np.corrcoef(t, p)[0, 1], "spearman_r": np.corrcoef(ranks(t), ranks(p))[0, 1],
        "explained_variance": 1 - e.var() / t.var(),
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name


def test_edge_metrics(spark):
    constant = metrics.regression_metrics(scored(spark, [(2.0, 1.0), (2.0, 3.0)])).first()
    assert constant["r2"] == 0 and constant["explained_variance"] == 0
    perfect = metrics.regression_metrics(scored(spark, [(1.0, 1.0), (2.0, 2.0)])).first()
    assert perfect["rmse"] == 0 and perfect["r2"] == 1 and perfect["spearman_r"] == pytest.approx(1)
    zero = metrics.regression_metrics(scored(spark, [(0.0, 1.0), (0.0, 2.0)])).first()
    assert math.isinf(zero["mape"])


def test_ranking_alignment(spark):
    assert metrics.ranking_alignment(scored(spark, [(3.0, 1.0), (3.0, 2.0)])).first()["ndcg"] == pytest.approx(1)
    got = metrics.ranking_alignment(scored(spark, [(1.0, 9.0), (5.0, 1.0)])).first()["ndcg"]
    assert got == pytest.approx((1 + 5 / math.log2(3)) / (5 + 1 / math.log2(3)))
    assert metrics.ranking_alignment(scored(spark, [(0.0, 1.0)])).first()["ndcg"] == 0


def test_calibration_and_bands_at_the_maximum(spark):
    rows = scored(spark, [(1.0, 1.5), (3.0, 3.0), (5.0, 4.0)])
    assert metrics.calibration_error(rows, 2).first()["ece"] == pytest.approx((0.5 + 0.0) / 3)
    assert metrics.calibration_error(rows, 2, include_right=True).first()["ece"] == pytest.approx(0.5 / 3 + 2 / 3 * 0.5)
    assert {r["band"] for r in metrics.score_bands(rows).collect()} == {"1-2", "3-4"}
    assert {r["band"] for r in metrics.score_bands(rows, include_right=True).collect()} == {"1-2", "3-4", "4-5"}


def test_fairness_and_groups(spark):
    rows = scored(spark, [(1.0, 2.0, "a"), (1.0, 2.0, "a"), (1.0, 4.0, "b"), (1.0, 4.0, "b"), (1.0, 9.0, "c"), (1.0, 9.0, None)], ", category string")
    got = {r["name"]: r["value"] for r in metrics.fairness(rows, "category").collect()}
    assert got == {"a": 1.0, "b": 3.0, "worst_group_rmse": 3.0, "rmse_gap": 2.0}
    assert metrics.group_breakdown(rows, "category").count() == 2
    empty = {r["name"]: r["value"] for r in metrics.fairness(rows.limit(0), "category").collect()}
    assert empty.get("worst_group_rmse") is None and empty["rmse_gap"] == 0


def test_report_and_examples(spark):
    rows = scored(spark, [(float(i), i + (i % 3) / 2, "ab"[i % 2], "p" * 200) for i in range(1, 13)], ", category string, prompt string")
    report = metrics.evaluation_report(rows, "m").collect()
    assert {r["scope"] for r in report} == {"global", "category", "errors"}
    worst = metrics.extreme_predictions(rows, 2).where("kind = 'worst'").collect()
    assert [r["error"] for r in worst] == [1.0, 1.0] and len(worst[0]["prompt"]) == 100


def test_hot_value_and_hot_group_ranks(spark):
    values = [7.0] * 400 + [float(i) for i in range(200)]
    rows = spark.createDataFrame([("hot", v) for v in values] + [("cold", 1.0)], "g string, v double").repartition(7)
    got = {(r["g"], r["v"]): r["avg_rank"] for r in ordering.average_ranks(rows, ["g"], "v").collect()}
    want = ranks(np.array(values))
    assert got[("cold", 1.0)] == 1
    assert all(got[("hot", v)] == w for v, w in zip(values, want))


@pytest.mark.parametrize("parts", [1, 6])
def test_running_sums_do_not_depend_on_partitions(spark, parts):
    rows = spark.range(1000).withColumn("x", F.col("id") % 13).repartition(parts)
    got = ordering.with_running_sum(rows, ["id"], "x").orderBy("id").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["x"]
    numbers = ordering.with_running_sum(rows, [F.desc("id")], None, "n").where("n <> 999 - id")
    assert numbers.count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    data = {g: rng.normal(size=n).round(2) for g, n in (("a", 1), ("b", 2), ("c", 501))}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("c", None)], "g string, v double")
    for r in ordering.exact_quantiles(rows, ["g"], "v", [0, 0.25, 0.5, 0.9, 1]).collect():
        assert r["quantiles"] == pytest.approx(np.quantile(data[r["g"]], [0, 0.25, 0.5, 0.9, 1]).tolist())


def test_paired_and_independent_tests(spark):
    # d = 1..5 has t = 3 / (sqrt(2.5) / sqrt 5) = 4.2426, two-sided p = 0.013236 at 4 degrees of freedom.
    rows = spark.createDataFrame([(i, 0.0, float(i), 0.0) for i in range(1, 6)], "id int, y_true double, y_pred double, y_pred_b double")
    got = significance.paired_ttest(rows).first()
    assert got["t_statistic"] == 4.2426 and got["p_value"] == pytest.approx(0.013236, abs=2e-6)
    w = significance.wilcoxon(rows).first()
    assert w["statistic"] == 0 and w["p_value"] == 0.0625
    assert significance.student_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert significance.student_two_sided(1.0, 1) == pytest.approx(0.5)
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "strategy string, composite_score double")
    pair = significance.pairwise_ttests(two).first()
    assert (pair["strategy_a"], pair["mean_diff"], pair["t_statistic"], pair["significant"]) == ("a", -1.0, -1.225, "No")
    assert pair["p_value"] == pytest.approx(0.2879, abs=1e-4)


def test_wilcoxon_with_ties_and_zeros(spark):
    d = [0.0, 1.0, 1.0, -1.0, 2.0, -3.0, 4.0]
    rows = spark.createDataFrame([(i, 0.0, 5 + x, 5.0) for i, x in enumerate(d)], "id int, y_true double, y_pred double, y_pred_b double")
    got = significance.wilcoxon(rows).first()
    kept = np.array([x for x in d if x])
    r = ranks(abs(kept))
    assert got["n"] == 6 and got["statistic"] == min(r[kept > 0].sum(), r[kept < 0].sum())


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0), ("b", None)], "g string, x double")
    bins = eda.histogram(rows, "x", 4).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [2, 0, 0, 1]
    assert [r["x"] for r in eda.fill_with_median(rows, ["x"]).where("g = 'b'").orderBy("x").collect()] == [2.0, 9.0]
    assert {r["column"]: r["nulls"] for r in eda.null_counts(rows).collect()} == {"g": 0, "x": 1}
    described = eda.describe(rows, ["x"]).first()
    assert (described["count"], described["p50"], described["max"]) == (3, 2.0, 9.0)
    constant = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert sum(r["count"] for r in eda.histogram(constant, "x", 3).collect()) == 2


def test_p_values_of_many_degrees_of_freedom():
    import math

    from qualitylab.operators import significance

    for df in (1e6, 2e6, 1e9, 1e12, 1e14):
        for t in (0.1, 1.0, 1.96, 4.0):
            assert abs(significance.student_two_sided(t, df) - math.erfc(t / math.sqrt(2))) < 1e-6


def test_wilcoxon_of_a_huge_tie_group(spark):
    from qualitylab.operators import significance

    rows = spark.range(3_000_000).selectExpr("id", "0D y_true", "1D y_pred", "2D y_pred_b")
    assert significance.wilcoxon(rows).first()["n"] == 3_000_000
