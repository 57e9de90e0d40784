"""Places in several scopes at once: hot values, null groups, few and many partitions; and the plans behind them."""

import random
import re

import numpy as np
import pytest

from qualitylab.operators import eda, metrics, ordering


@pytest.fixture(scope="module")
def rows():
    """Half of the truths are 5.0, one group holds most rows, some groups are null."""
    chance = random.Random(4)
    out = []
    for i in range(900):
        t = 5.0 if i // 3 % 2 else round(chance.uniform(1, 5), 1)
        out.append((i, t, round(chance.uniform(1, 5), 2) if i % 3 else 3.0, None if i % 17 == 0 else "hot" if i % 5 else f"g{i % 4}", f"d{i % 2}"))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, y_true double, y_pred double, category string, difficulty string").repartition(7)


def plain(values, v):
    low = sum(x < v for x in values)
    return low, sum(x == v for x in values), len(values)


def test_places_in_every_scope(frame, rows):
    scopes = {"all": [], "cat": ["category"], "both": ["category", "difficulty"]}
    got = ordering.placed(frame, "y_true", scopes, "p_").collect()
    assert len(got) == len(rows)
    of = {"all": lambda r: (), "cat": lambda r: (r[3],), "both": lambda r: (r[3], r[4])}
    for r in got:
        own = next(x for x in rows if x[0] == r["id"])
        for scope, key in of.items():
            found = (r[f"p_{scope}_low"], r[f"p_{scope}_ties"], r[f"p_{scope}_size"])
            if None in key(own):
                assert found == (None, None, None)
            else:
                assert found == plain([x[1] for x in rows if key(x) == key(own)], own[1])


def average(values):
    order = np.sort(values)
    return (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2


def test_scoped_metrics_equal_metrics_of_each_group(frame, rows):
    report = {(r.scope, r.grp, r.metric): r.value for r in metrics.evaluation_report(frame, "m").collect()}
    for scope, at in (("global", None), ("category", 3), ("difficulty", 4)):
        groups = {"all"} if at is None else {r[at] for r in rows if r[at] is not None}
        assert {g for s, g, _ in report if s == scope} == groups
        for g in groups:
            t, p = np.array([r[1:3] for r in rows if at is None or r[at] == g]).T
            want = {"n": len(t), "rmse": np.sqrt(((t - p) ** 2).mean()), "medae": np.median(abs(t - p)),
                    "spearman_r": np.corrcoef(average(t), average(p))[0, 1], "max_error": abs(t - p).max()}
            for metric, value in want.items():
                assert report[(scope, g, metric)] == pytest.approx(value, abs=6e-5)


def exchanges(df):
    return re.findall(r"Exchange (\w+)\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def test_no_exchange_has_a_value_or_a_group_alone_as_its_key(frame):
    placed = ordering.placed(frame, "y_true", {"all": [], "cat": ["category"]}, "p_")
    hashed = [keys for kind, keys in exchanges(placed) if kind == "hashpartitioning"]
    rows = [k for k in hashed if re.match(r"_part#\d+, \d+$", k)]
    assert rows  # the rows go by their sort partition; the other exchanges carry cells, which have been summed before
    assert not any("y_true" in k and "_part" not in k for k in hashed)


def test_constant_and_empty_inputs(spark, frame):
    same = frame.selectExpr("id", "4.0D AS y_true", "y_pred", "category", "difficulty")
    assert ordering.spearman(same, [], "y_true", "y_pred").first()[0] is None
    nothing = metrics.regression_metrics(frame.limit(0)).first()
    assert nothing["n"] == 0 and nothing["medae"] is None
    assert metrics.regression_metrics(frame.limit(0), ["category"]).isEmpty()


def test_box_plot_of_hot_values(frame, rows):
    got = {r.difficulty: r for r in eda.box_plot(frame, "difficulty", "y_pred").collect()}
    for g in ("d0", "d1"):
        v = np.array([r[2] for r in rows if r[4] == g])
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
        assert (got[g].q1, got[g].med, got[g].q3) == pytest.approx((q1, med, q3))
        assert (got[g].whisker_low, got[g].whisker_high, got[g].outliers) == (v[inside].min(), v[inside].max(), (~inside).sum())
