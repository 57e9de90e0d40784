"""AdaBoost.R2 against a plain repetition of its rounds, linear SVR by its duality gap."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from qualitylab.operators import models, robust


def table(spark, x, y):
    data = [(i, None if t is None else float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(data, ["id", "y", "features"]).repartition(5)


@pytest.fixture(scope="module")
def numbers():
    chance = np.random.default_rng(5)
    x = chance.normal(size=(160, 3))
    y = 2 * x[:, 0] - x[:, 1] + np.where(x[:, 2] > 0.5, 3.0, 0.0) + chance.normal(size=160) * 0.2
    y[:6] += 25  # outliers
    return x, y


def primal(w, b, x, y, c, epsilon):
    return w @ w / 2 + c * np.maximum(np.abs(y - x @ w - b) - epsilon, 0).sum()


@pytest.mark.parametrize(("c", "epsilon"), [(1.0, 0.1), (0.05, 0.5)])
def test_svr_is_at_the_least(spark, numbers, c, epsilon):
    x, y = numbers
    rows = table(spark, x, y)
    model = robust.LinearSvr(c, epsilon).fit(rows)
    found = primal(model.coefficients, model.intercept, x, y, c, epsilon)
    # Any a in [-c, c] with sum 0 gives a bound from below; the slopes of the rounded loss are nearly such numbers.
    corner = robust.CORNERS[-1] * y.std()
    a = c * robust.rounded_loss(y - x @ model.coefficients - model.intercept, epsilon, corner)[1]
    a -= a.mean()
    a *= min(1.0, c / np.abs(a).max())
    bound = a @ y - epsilon * np.abs(a).sum() - (x.T @ a) @ (x.T @ a) / 2
    assert bound <= found <= bound + 1e-4 * found
    got = np.array([r["prediction"] for r in model.transform(rows).orderBy("id").collect()])
    assert got == pytest.approx(x @ model.coefficients + model.intercept)
    least_squares = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    clean = slice(6, None)
    assert np.abs(y - got)[clean].mean() < np.abs(y - x @ least_squares[:-1] - least_squares[-1])[clean].mean()


def test_svr_edges(spark):
    flat = table(spark, np.ones((4, 2)), [3.0, 3.0, 3.0, None])
    assert robust.LinearSvr().fit(flat).transform(flat).agg(F.max(F.abs(F.col("prediction") - 3))).first()[0] <= 0.1 + 1e-6
    with pytest.raises(ValueError):
        robust.LinearSvr().fit(flat.where("id < 0"))


def test_boosting_by_hand(spark, numbers):
    x, y = numbers
    rows = table(spark, x, y)
    model = robust.AdaBoost(rounds=10).fit(rows)
    w, kept = np.ones(len(y)), []
    for tree, weight in zip(model.trees, model.weights):
        p = np.array([tree.predict(Vectors.dense(v)) for v in x])
        e = np.abs(y - p) / np.abs(y - p).max()
        loss = (w * e).sum() / w.sum()
        beta = loss / (1 - loss)
        assert weight == pytest.approx(math.log(1 / beta), rel=1e-6)
        w = w * beta ** (1 - e)
        kept.append(p)
    assert len(kept) > robust.ROUNDS_AT_ONCE
    want = []
    for row in np.array(kept).T:
        order = np.argsort(row, kind="stable")
        upto = np.cumsum(np.array(model.weights)[order])
        want.append(row[order][np.argmax(upto >= sum(model.weights) / 2 - 1e-12)])
    got = [r["prediction"] for r in model.transform(rows).orderBy("id").collect()]
    assert got == pytest.approx(want)


def test_boosting_ends_at_a_perfect_tree(spark):
    rows = table(spark, np.array([[0.0], [1.0], [2.0], [3.0]]), [1.0, 1.0, 5.0, 5.0])
    model = robust.AdaBoost(rounds=20).fit(rows)
    assert len(model.trees) == 1 and model.weights == [1.0]
    assert [r["prediction"] for r in model.transform(rows).orderBy("id").collect()] == [1.0, 1.0, 5.0, 5.0]


def test_by_name(spark, numbers):
    rows = table(spark, *numbers)
    fitted = models.fit_models(rows, ["svr_linear", "ada_boost", "nothing"], {"ada_boost": {"rounds": 3}})
    assert set(fitted.models) == {"svr_linear", "ada_boost"}
    assert fitted.predict(rows).where("svr_linear is null or ada_boost is null").count() == 0
