"""Linear models from Gram matrices against refits on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from qualitylab.operators import gram, models, sampling


@pytest.fixture(scope="module")
def rows(spark):
    chance = np.random.default_rng(8)
    x = chance.normal(size=(230, 5)) * [1, 1000, 0.01, 5, 1] + [0, 5000, 3, -2, 0]
    x[:, 4] = 7.0  # a constant feature
    y = x[:, 0] - 0.002 * x[:, 1] + 30 * x[:, 2] + chance.normal(size=230) * 0.3
    data = [(i, float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame([*data, (900, None, Vectors.dense([0.0] * 5))], ["id", "y", "features"]).repartition(6)


def test_folds_equal_refits(spark, rows):
    names = ["linear", "ridge", "lasso", "elastic_net"]
    labelled = rows.where("y is not null")
    params = {"ridge": {"alpha": 20.0}, "lasso": {"alpha": 0.2}}
    got = {(r["model"], r["fold"]): (r["rmse"], r["r2"]) for r in models.cross_validate(labelled, names, 4, params).collect()}
    held = models.out_of_fold(labelled, names, 4, params).toPandas()
    assert len(got) == 16
    for (name, fold), (rmse, r2) in got.items():
        own = held[held.fold == fold]
        error = own.y - own[name]
        assert rmse == pytest.approx(np.sqrt((error**2).mean()), rel=2e-5)
        assert r2 == pytest.approx(1 - (error**2).sum() / ((own.y - own.y.mean()) ** 2).sum(), abs=2e-5)


def test_grid_equals_fits(rows):
    train, held = sampling.random_split(rows.where("y is not null"))
    best, score, table = models.grid_search(train, held, "ridge", {"alpha": [0.01, 1.0, 100.0]})
    found = {r["params"]: r["rmse"] for r in table.collect()}
    for alpha in (0.01, 1.0, 100.0):
        fitted = models.fit_models(train, ["ridge"], {"ridge": {"alpha": alpha}})
        want = models.scores_of(fitted.predict(held), ["ridge"]).first()["rmse"]
        assert found[str({"alpha": alpha})] == pytest.approx(want, rel=1e-6)
    assert score == min(found.values()) and found[str(best)] == score


def test_rows_without_target_and_empty_folds(rows):
    folded = sampling.with_folds(rows, 3)
    assert gram.fold_grams(folded, 3)[:, 0, 0].sum() == 230
    few = rows.where("id < 3")
    assert {f for _, f, _, _ in gram.cross_validated(sampling.with_folds(few, 5), {"linear": {}}, 5)} == {0, 1, 2}
    assert gram.cross_validated(sampling.with_folds(rows.limit(0), 3), {"linear": {}}, 3) == []


def test_no_limit_of_depth_is_said(rows):
    with pytest.warns(UserWarning, match="depth 30"):
        models.grid_search(rows.where("y is not null"), rows.where("id < 50"), "decision_tree", {"maxDepth": [None], "seed": [1]})
