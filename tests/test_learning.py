"""TF-IDF, SVD, k-NN, models, ensembles, training job and streams."""

import math
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from qualitylab.functions import fixed
from qualitylab.operators import ensembles, knn, models, tfidf
from qualitylab.plans import scoring, training
from qualitylab.sources import views
from qualitylab.streaming import scoring as streaming

TEXTS = ["cats chase mice", "cats chase cats daily", "dogs sleep", "mice sleep daily daily", ""]


def test_tfidf_against_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    settings = tfidf.TfIdf(ngram_range=(1, 2), max_features=6, min_df=2, max_df=0.9, stop_words=["the"])
    vocabulary = settings.fit(rows, "t")
    grams = [[" ".join(w[i:i + n]) for n in (1, 2) for i in range(len(w) - n + 1)] for w in (t.split() for t in TEXTS)]
    df = Counter(g for gs in grams for g in set(gs))
    total = Counter(g for gs in grams for g in gs)
    kept = sorted([g for g in df if 2 <= df[g] <= 0.9 * 5], key=lambda g: (-total[g], g))[:6]
    assert [r["term"] for r in vocabulary.orderBy("index").collect()] == sorted(kept)
    got = {(r["id"], r["term"]): r["weight"] for r in settings.transform(rows, "t", vocabulary).collect()}
    want = {}
    for i, gs in enumerate(grams):
        w = {g: (1 + math.log(c)) * (math.log(6 / (1 + df[g])) + 1) for g, c in Counter(gs).items() if g in kept}
        for g, x in w.items():
            want[(i, g)] = x / math.sqrt(sum(v * v for v in w.values()))
    assert got == pytest.approx(want)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(40, 8)) * (rng.random((40, 8)) < 0.5)
    cells = [(i, j, float(x)) for (i, j), x in np.ndenumerate(matrix) if x]
    weights = spark.createDataFrame(cells, "id int, index long, weight double")
    keys = spark.range(40).select(F.col("id").cast("int").alias("id"))
    rows = tfidf.to_rows(weights, 8, "id", keys)
    svd = tfidf.fit_svd(rows, 8, 3)
    assert svd.singular_values == pytest.approx(np.linalg.svd(matrix)[1][:3])
    out = svd.transform(rows)
    projected = np.array([r["svd"] for r in out.orderBy("id").collect()])
    assert projected == pytest.approx(matrix @ svd.vectors)
    curve = tfidf.explained_variance(out, weights, 3).orderBy("component").collect()
    assert [r["ratio"] for r in curve] == pytest.approx((projected.var(axis=0) / matrix.var(axis=0).sum()).tolist())


@pytest.mark.parametrize("kind", ["spread", "crowded"])
def test_knn_is_exact_when_cells_are_cut(spark, kind):
    rng = np.random.default_rng(3)
    train = rng.normal(size=(300, 4)) + 5 * rng.integers(0, 4, size=(300, 1))
    if kind == "crowded":
        train[:150] = train[0]  # half of all rows are copies of one
    query = np.vstack([rng.normal(size=(40, 4)), train[:3]])
    y = rng.normal(size=300)
    frame = lambda m, **c: spark.createDataFrame([(i, [float(v) for v in r], *(float(c[k][i]) for k in c)) for i, r in enumerate(m)], "id int, features array<double>" + ", y double" * len(c))
    got = knn.nearest(frame(train, y=y), frame(query), 5, pivots=7, block_rows=20).collect()
    gaps = np.sqrt(((query[:, None] - train[None]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(np.arange(300), gaps.shape), gaps))[:, :5]
    mine = {i: [] for i in range(len(query))}
    for r in sorted(got, key=lambda r: (r["distance"], r["neighbour"])):
        mine[r["id"]].append(r["neighbour"])
    assert mine == {i: list(row) for i, row in enumerate(order)}
    predicted = {r["id"]: r["y_pred"] for r in knn.knn_regression(frame(train, y=y), frame(query), 5, pivots=7, block_rows=20).collect()}
    for i, row in enumerate(order):
        d = gaps[i, row]
        want = y[row][d == 0].mean() if (d == 0).any() else (y[row] / d).sum() / (1 / d).sum()
        assert predicted[i] == pytest.approx(want)


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [1, 2, 3, 4, 5] + 7
    y = x @ [0.5, -0.3, 0.2, 0, 0] + rng.normal(0, 0.3, 200)
    rows = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(200)], "id int, y double, v array<double>")
    return x, y, rows.select("id", "y", array_to_vector("v").alias("features")).cache()


def test_linear_models_against_closed_forms(linear):
    x, y, rows = linear
    z, yc = (x - x.mean(0)) / x.std(0), y - y.mean()
    fitted = models.fit_models(rows, ["linear", "ridge", "lasso", "elastic_net", "nothing"])
    assert list(fitted.models) == ["linear", "ridge", "lasso", "elastic_net"]
    w = {n: m.coefficients.toArray() for n, m in fitted.models.items()}
    assert w["linear"] == pytest.approx(np.linalg.lstsq(z, yc, rcond=None)[0], abs=1e-8)
    assert w["ridge"] == pytest.approx(np.linalg.solve(z.T @ z + np.eye(5), z.T @ yc), abs=1e-8)
    for name, l1, l2 in (("lasso", 0.01, 0), ("elastic_net", 0.005, 0.005)):
        slope = z.T @ (yc - z @ w[name]) / 200 - l2 * w[name]
        on = w[name] != 0
        assert slope[on] == pytest.approx(l1 * np.sign(w[name][on]), abs=1e-5) and (abs(slope) <= l1 + 1e-5).all()


def test_leaderboard_and_best(linear):
    _, _, rows = linear
    train, held = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    fitted = models.fit_models(train, ["ridge", "decision_tree", "knn"])
    board = models.leaderboard(fitted, held, train, 3).collect()
    assert board[0]["model"] == "ridge" and board[0]["cv_rmse_mean"] < 0.5
    assert models.best_model(models.leaderboard(fitted, held)) == "ridge"
    best, score, tried = models.grid_search(train, held, "ridge", fixed.SEARCH_GRIDS["ridge"])
    assert tried.count() == 4 and score < 0.5 and best["alpha"] in fixed.SEARCH_GRIDS["ridge"]["alpha"]
    with pytest.raises(RuntimeError):
        models.best_model(models.leaderboard(fitted, held).limit(0))


def test_ensembles(linear):
    _, _, rows = linear
    bases = ["ridge", "decision_tree"]
    stack = ensembles.fit_stacking(rows, bases, 3).predict(rows)
    assert stack.where("y_pred < 1 or y_pred > 5").count() == 0 and stack.count() == 200
    voted = ensembles.fit_voting(rows, bases).predict(rows)
    gap = F.abs(F.col("y_pred") - F.least(F.greatest((F.col("ridge") + F.col("decision_tree")) / 2, F.lit(1)), F.lit(5)))
    assert voted.agg(F.max(gap)).first()[0] < 1e-9
    blended = ensembles.fit_blending(rows, {"ridge": 3.0, "decision_tree": 1.0}).predict(rows)
    gap = F.abs(F.col("y_pred") - F.least(F.greatest(0.75 * F.col("ridge") + 0.25 * F.col("decision_tree"), F.lit(1)), F.lit(5)))
    assert blended.agg(F.max(gap)).first()[0] < 1e-9


def target_rows(spark, small):
    return views.responses(spark, small).withColumn("composite_score", F.least(1 + F.char_length("response") / 1000, F.lit(5.0)))


def test_quality_model_round_trip_and_stream(spark, small, tmp_path):
    rows = target_rows(spark, small)
    model, _ = scoring.fit_quality_model(rows, kind="voting", bases=["ridge", "decision_tree"], svd=5)
    model.save(str(tmp_path / "m"))
    loaded = scoring.QualityModel.load(spark, str(tmp_path / "m"))
    new = rows.drop("composite_score").withColumn("category", F.when(F.col("id") % 2 == 0, "unseen").otherwise(F.col("category")))
    want = {r["id"]: r["y_pred"] for r in model.predict(new).collect()}
    assert {r["id"]: r["y_pred"] for r in loaded.predict(new).collect()} == pytest.approx(want)
    new.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in new.dtypes)
    source = streaming.read_stream(spark, str(tmp_path / "in"), schema)
    streaming.score_stream(source, loaded, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["id"]: r["y_pred"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx(want)
    described = streaming.describe_stream(source).select("id", "response_clean", "sentence_count")
    streaming.write_stream(described, str(tmp_path / "d"), str(tmp_path / "dck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "d")).count() == len(want)


def test_training_job(spark, small, tmp_path):
    config = training.TrainingConfig("all", augment=True, cv_folds=2, names=["ridge"], bases=["ridge", "decision_tree"], output=str(tmp_path))
    result = training.run_training(target_rows(spark, small), views.annotations(spark, small), config)
    assert result.n_train == 320 and result.n_val == 40
    assert {r["model"] for r in result.report.collect()} == {"ridge", "stacking"}
    assert spark.read.json(str(tmp_path / "training_results")).count() == 20


@pytest.mark.parametrize("kind", ["normal", "ties", "far", "few", "missing"])
def test_blocks_by_matrix_product_equal_differences(kind):
    rng = np.random.default_rng(5)
    asked, stocked = rng.normal(size=(150, 6)), rng.normal(size=(900, 6))
    if kind == "ties":
        asked, stocked = np.round(asked), np.round(stocked)
    elif kind == "far":  # products of such vectors have no digit left for the distances
        asked, stocked = asked * 1e-6 + 1e6, stocked * 1e-6 + 1e6
    elif kind == "few":
        stocked = stocked[:3]
    elif kind == "missing":
        stocked[4, 2], stocked[9, 1] = np.nan, np.inf
    gaps = knn._distances(asked, stocked)
    best = gaps.argsort(axis=1, kind="stable")[:, :5]
    rows, picks, found = knn._closest(asked, stocked, 5)
    assert rows.tolist() == np.repeat(np.arange(150), best.shape[1]).tolist() and picks.tolist() == best.ravel().tolist()
    assert np.array_equal(found, np.take_along_axis(gaps, best, axis=1).ravel(), equal_nan=True)


def test_fits_take_no_more_tasks_than_cores_and_rows_ask_for(spark, monkeypatch):
    rows = spark.range(1000).select("id", F.col("id").cast("double").alias("y"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    seen = []

    class Learner:
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return self

    monkeypatch.setitem(models.ALL_MODELS, "counting", models.Spec(lambda s: Learner()))
    for parts, a_task in ((40, 50_000), (40, 50), (3, 50_000)):
        monkeypatch.setattr(models, "ROWS_A_TASK", a_task)
        models.fit_models(rows.repartition(parts), ["counting"], scale=False)
    assert seen == [8, 20, 3]


def test_text_is_measured_once_for_fit_and_predictions(spark, small):
    from qualitylab.catalog import learning

    plan = learning.text_rows(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "Scan parquet" not in plan


def test_boosting_gets_as_few_tasks_as_its_values_ask_for(spark, monkeypatch):
    rows = [(i, float(i % 7), [float(i % 7), float(i % 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, y double, v array<double>").repartition(8)
    seen = {}

    class Recording:
        def __init__(self, name):
            self.name = name

        def fit(self, ready):
            seen[self.name] = ready.rdd.getNumPartitions()

    monkeypatch.setattr(models, "build", lambda name, stats, overrides=None: Recording(name))
    frame = df.select("id", "y", array_to_vector("v").alias("features"))
    models.fit_models(frame, ["gradient_boosting", "random_forest"])
    assert seen == {"gradient_boosting": 1, "random_forest": 8}
    monkeypatch.setattr(models, "BOOSTED_VALUES", 54)
    models.fit_models(frame, ["gradient_boosting"])
    assert seen["gradient_boosting"] == 3


def test_bases_on_all_rows_are_fitted_beside_those_of_the_folds(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 5), [float(i % 5), float(i % 3)]) for i in range(40)], "id int, y double, v array<double>")
    frame = df.select("id", "y", array_to_vector("v").alias("features"))
    started, fit, held_out, validated = threading.Event(), models.fit_models, models.out_of_fold, models.cross_validate

    def whole(train, *rest):
        if "fold" not in train.columns and train is frame:
            started.set()
        return fit(train, *rest)

    def waiting(run):
        def held(*given):
            assert started.wait(20), "the folds came first"
            return run(*given)
        return held

    monkeypatch.setattr(models, "fit_models", whole)
    monkeypatch.setattr(models, "out_of_fold", waiting(held_out))
    stack = ensembles.fit_stacking(frame, ["ridge", "decision_tree"], 3)
    assert stack.predict(frame).where("y_pred IS NULL").count() == 0
    started.clear()
    monkeypatch.setattr(models, "cross_validate", waiting(validated))
    fitted, board = models.fitted_board(frame, frame, ["linear", "ridge"], folds=3)
    assert board.collect() == models.leaderboard(fitted, frame, frame, 3).collect()
