"""Baseline regressors on MLlib over ``(id, y, features)`` frames.

Features are scaled once (population deviation) and shared by all models. Training
frames should be persisted by the caller; every fit is a distributed MLlib job.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitylab.operators import gram, knn, metrics, ordering, robust, sampling
from qualitylab.session import FEW, concurrently

#: The depth at which the tree learner ends.
DEEPEST = 30
#: Rows that a task of a fit takes at least, once there are tasks for all cores. Boosting runs hundreds of small jobs, whose time is that of starting tasks.
ROWS_A_TASK = 50_000
#: Feature values (rows times features) that a task of a boosting takes, whatever the cores: its jobs come one after another, several a tree, and a
#: task over fewer values takes longer to start than to run.
BOOSTED_VALUES = 500_000
COLUMNS = {"featuresCol": "features", "labelCol": "y"}


@dataclass(frozen=True)
class LabelStats:
    """Row count and population deviation of the target: MLlib scales penalties by them."""

    rows: int
    deviation: float

    @classmethod
    def of(cls, df: DataFrame) -> "LabelStats":
        rows, deviation = df.agg(F.count("y"), F.stddev_pop("y")).first()
        return cls(rows, deviation or 1.0)


def _penalised(stats: LabelStats, l1: float, l2: float) -> LinearRegression:
    """Least squares with penalties in the usual units: ``1/2n·RSS + l1·|w| + l2/2·|w|²``.

    The normal-equation solver reads the rows once, whatever the number of iterations; it
    takes up to 4096 features, which the vocabulary and component limits keep us under.
    """
    l2 = l2 * stats.deviation
    whole = l1 + l2
    return LinearRegression(
        **COLUMNS, regParam=whole, elasticNetParam=l1 / whole if whole else 0.0,
        standardization=False, solver="normal", maxIter=500, tol=1e-7,
    )


class KnnRegressor:
    """The k-NN join behind the fit/transform shape of the other models."""

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, train: DataFrame) -> "KnnRegressor":
        fitted = KnnRegressor(self.k)
        fitted.train = train.select("id", "y", vector_to_array("features").alias("features"))
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        asked = df.select("id", vector_to_array("features").alias("features"))
        found = knn.knn_regression(self.train, asked, self.k)
        return df.join(found.withColumnRenamed("y_pred", "prediction"), "id", "left")


@dataclass(frozen=True)
class Spec:
    build: Callable
    params: dict = field(default_factory=dict)
    description: str = ""


MODEL_REGISTRY: dict[str, Spec] = {
    "linear": Spec(lambda s: _penalised(s, 0, 0), {}, "Ordinary least squares."),
    "ridge": Spec(lambda s, alpha: _penalised(s, 0, alpha / s.rows), {"alpha": 1.0},
                  "Least squares with a squared penalty."),
    "lasso": Spec(lambda s, alpha: _penalised(s, alpha, 0), {"alpha": 0.01},
                  "Least squares with an absolute penalty; drops weak features."),
    "elastic_net": Spec(lambda s, alpha, l1_ratio: _penalised(s, alpha * l1_ratio, alpha * (1 - l1_ratio)),
                        {"alpha": 0.01, "l1_ratio": 0.5}, "Both penalties mixed."),
    "random_forest": Spec(lambda s, **p: RandomForestRegressor(**COLUMNS, featureSubsetStrategy="all", **p),
                          {"numTrees": 200, "maxDepth": 10, "seed": 42}, "Averaged bootstrap trees."),
    "gradient_boosting": Spec(lambda s, **p: GBTRegressor(**COLUMNS, **p),
                              {"maxIter": 150, "maxDepth": 5, "stepSize": 0.1, "seed": 42},
                              "Trees fitted one after another to the residuals."),
    "knn": Spec(lambda s, k: KnnRegressor(k), {"k": 5}, "Distance-weighted nearest neighbours."),
    "decision_tree": Spec(lambda s, **p: DecisionTreeRegressor(**COLUMNS, **p),
                          {"maxDepth": 8, "seed": 42}, "One tree."),
}

#: Fitted where they are named. Boards over the whole registry leave them out: each is a long run of small jobs.
ROBUST_MODELS: dict[str, Spec] = {
    "ada_boost": Spec(lambda s, **p: robust.AdaBoost(**p), {"rounds": 100, "max_depth": 3, "rate": 1.0, "seed": 42},
                      "Shallow trees, each fitted with more weight on rows that the ones before it miss."),
    "svr_linear": Spec(lambda s, **p: robust.LinearSvr(**p), {"c": 1.0, "epsilon": 0.1},
                       "Linear support vector regression."),
}
ALL_MODELS = MODEL_REGISTRY | ROBUST_MODELS


def list_models(spark: SparkSession) -> DataFrame:
    rows = [(name, str(spec.params), spec.description) for name, spec in ALL_MODELS.items()]
    return spark.createDataFrame(rows, "name string, params string, description string")


def assemble(df: DataFrame, columns: Sequence[str], target: str, key: str = "id") -> DataFrame:
    """``(id, y, features)`` from numeric, array-free columns."""
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return ready.select(F.col(key).alias("id"), F.col(target).cast("double").alias("y"), "features")


def fit_scaler(train: DataFrame) -> PipelineModel:
    """Scaler to zero mean and unit population deviation (MLlib's own uses the sample one)."""
    scaler = StandardScaler(inputCol="features", outputCol="_z", withMean=True).fit(train)
    rows = train.count()
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    stretch = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * scaler.mean.size), inputCol="_z", outputCol="_scaled"
    )
    return PipelineModel(stages=[scaler, stretch])


def _scaled(df: DataFrame, scaler: PipelineModel | None) -> DataFrame:
    if scaler is None:
        return df
    out = scaler.transform(df)
    return out.withColumn("features", F.col("_scaled")).drop("_z", "_scaled")


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, cached and of ``rows`` rows, in no more partitions than cores or enough rows ask for; nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = max(cores, FEW, rows // ROWS_A_TASK)
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def _boosted(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df``, cached and of ``rows`` rows of ``width`` features, in partitions for a boosting; nothing is shuffled."""
    most = max(1, -(-rows * width // BOOSTED_VALUES))
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def build(name: str, stats: LabelStats, overrides: Mapping | None = None):
    spec = ALL_MODELS[name]
    return spec.build(stats, **{**spec.params, **(overrides or {})})


@dataclass
class Fitted:
    """Fitted models that share one scaler."""

    scaler: PipelineModel | None
    models: dict
    params: Mapping[str, Mapping] = field(default_factory=dict)

    def predict(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Add one prediction column per model, named after it. MLlib models add columns in
        place (no join); only k-NN joins."""
        out = _scaled(df, self.scaler)
        for name in names or self.models:
            out = self.models[name].transform(out).withColumnRenamed("prediction", name)
        return out


def fit_models(
    train: DataFrame, names: Sequence[str] | None = None,
    params: Mapping[str, Mapping] | None = None, scale: bool = True,
) -> Fitted:
    """Fit the named models (without names, all of MODEL_REGISTRY); unknown names are skipped."""
    params = params or {}
    shared = train.is_cached  # then it is the caller's to release
    train = train.persist()
    scaler = fit_scaler(train) if scale else None
    rows = train.count()
    ready = _packed(_scaled(train, scaler), rows)
    stats = LabelStats.of(ready)
    wanted = [n for n in (names or MODEL_REGISTRY) if n in ALL_MODELS]
    frames = {}
    if "gradient_boosting" in wanted and rows:
        frames["gradient_boosting"] = _boosted(ready, rows, ready.select("features").first()["features"].size)
    fits = concurrently(train.sparkSession, [lambda n=n: build(n, stats, params.get(n)).fit(frames.get(n, ready)) for n in wanted])
    models = dict(zip(wanted, fits))
    if not shared and "knn" not in models:
        train.unpersist()
    return Fitted(scaler, models, params)


def scores_of(predicted: DataFrame, names: Sequence[str]) -> DataFrame:
    """RMSE, MAE and R² per model from one aggregation of a wide prediction frame."""
    rows = [F.struct(F.lit(n).alias("model"), F.col(n).alias("y_pred")) for n in names]
    long = predicted.select(F.col("y").alias("y_true"), F.inline(F.array(*rows)))
    return long.groupBy("model").agg(
        metrics.rmse().alias("rmse"), metrics.mae().alias("mae"), metrics.r2().alias("r2")
    )


def out_of_fold(
    train: DataFrame, names: Sequence[str], folds: int = 5, params: Mapping[str, Mapping] | None = None,
    scale: bool = True,
) -> DataFrame:
    """Each row predicted by models fitted on the other folds: ``(id, y, fold, <model>…)``."""
    folded = sampling.with_folds(train, folds).persist()
    folded.count()  # filled once, before the folds' fits run side by side

    def held_out(fold: int) -> DataFrame:
        fitted = fit_models(folded.where(F.col("fold") != fold).drop("fold"), names, params, scale)
        held = fitted.predict(folded.where(F.col("fold") == fold), fitted.models)
        return held.select("id", "y", "fold", *fitted.models)

    parts = concurrently(train.sparkSession, [lambda fold=fold: held_out(fold) for fold in range(folds)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_validate(
    train: DataFrame, names: Sequence[str], folds: int = 5, params: Mapping[str, Mapping] | None = None
) -> DataFrame:
    """RMSE and R² per model and fold. Linear models of all folds come from one scan (see ``gram``); the others are refitted."""
    params = params or {}
    linear = {n: {**ALL_MODELS[n].params, **params.get(n, {})} for n in names if n in gram.LINEAR}
    others = [n for n in names if n not in linear]
    schema = "model string, fold int, rmse double, r2 double"
    found = gram.cross_validated(sampling.with_folds(train, folds), linear, folds) if linear else []
    out = train.sparkSession.createDataFrame(found, schema)
    if others:
        held = out_of_fold(train, others, folds, params)
        rows = [F.struct(F.lit(n).alias("model"), F.col(n).alias("y_pred")) for n in others]
        long = held.select("fold", F.col("y").alias("y_true"), F.inline(F.array(*rows)))
        out = out.union(long.groupBy("model", "fold").agg(metrics.rmse().alias("rmse"), metrics.r2().alias("r2")))
    return out


def cv_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("model").agg(
        F.round(F.avg("rmse"), 4).alias("cv_rmse_mean"), F.round(F.stddev_pop("rmse"), 4).alias("cv_rmse_std"),
        F.round(F.avg("r2"), 4).alias("cv_r2_mean"), F.round(F.stddev_pop("r2"), 4).alias("cv_r2_std"),
    )


def leaderboard(
    fitted: Fitted, validation: DataFrame, train: DataFrame | None = None, folds: int = 5,
    per_fold: DataFrame | None = None,
) -> DataFrame:
    """Validation scores per model, with cross-validation on ``train`` when given, best R² first. ``per_fold`` is that
    cross-validation where it has run already."""
    names = list(fitted.models)
    board = scores_of(fitted.predict(validation, names), names)
    board = board.select("model", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")])
    if per_fold is None and train is not None:
        per_fold = cross_validate(train, names, folds, fitted.params)
    if per_fold is not None:
        cv = cv_summary(per_fold)
        board = board.join(cv.select("model", "cv_rmse_mean", "cv_rmse_std"), "model")
    return board.orderBy(F.desc("r2"), "model")


def fitted_board(
    train: DataFrame, validation: DataFrame, names: Sequence[str] | None = None,
    params: Mapping[str, Mapping] | None = None, folds: int = 5,
) -> tuple[Fitted, DataFrame]:
    """The models fitted on ``train`` and their leaderboard with cross-validation; the fits and those of the folds run side by side."""
    wanted = [n for n in (names or MODEL_REGISTRY) if n in ALL_MODELS]
    fitted, per_fold = concurrently(train.sparkSession, [
        lambda: fit_models(train, names, params), lambda: cross_validate(train, wanted, folds, params),
    ])
    return fitted, leaderboard(fitted, validation, per_fold=per_fold)


def best_model(board: DataFrame, metric: str = "r2") -> str:
    """Name of the best row; fails when nothing was evaluated."""
    row = ordering.arg_max(board, "model", metric, largest=metric == "r2").first()
    if row is None:
        raise RuntimeError("evaluate the models first")
    return row["model"]


def feature_importance(model, columns: Sequence[str]) -> DataFrame:
    """Importances of a tree model or coefficients of a linear one, largest first."""
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    spark = SparkSession.active()
    rows = [(name, float(w)) for name, w in zip(columns, weights.toArray())]
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.desc("weight"), "feature")


def top_coefficients(importance: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest and ``k`` smallest weights."""
    up = ordering.top(importance, k, F.desc("weight"), "feature").withColumn("side", F.lit("positive"))
    down = ordering.top(importance, k, F.asc("weight"), "feature").withColumn("side", F.lit("negative"))
    return up.unionByName(down)


def grid_search(
    train: DataFrame, validation: DataFrame, name: str, grid: Mapping[str, Sequence], metric: str = "rmse"
) -> tuple[dict, float, DataFrame]:
    """Fit every combination; return the best one, its score and all ``(params, score)`` rows.

    Linear models need one scan of each side. The trees' ``maxDepth`` None means no limit, for which this takes DEEPEST, the
    deepest that the tree learner allows, and warns.
    """
    combinations = [dict(zip(grid, combination)) for combination in itertools.product(*grid.values())]
    spark = train.sparkSession
    if name in gram.LINEAR:
        both = [gram.fold_grams(side.withColumn("fold", F.lit(0)), 1)[0] for side in (train, validation)]
        rows = [(str(p), r2 if metric == "r2" else rmse) for p, rmse, r2 in gram.grid(*both, name, combinations)]
        at = (max if metric == "r2" else min)(range(len(rows)), key=lambda i: rows[i][1])
        return combinations[at], rows[at][1], spark.createDataFrame(rows, f"params string, {metric} double")
    scaler = fit_scaler(train)
    ready, check = _scaled(train, scaler).persist(), _scaled(validation, scaler).persist()
    stats = LabelStats.of(ready)
    tried = []
    for chosen in combinations:
        if "maxDepth" in chosen and chosen["maxDepth"] is None:
            warnings.warn(f"maxDepth None: trees end at depth {DEEPEST}", stacklevel=2)
        settings = {k: DEEPEST if k == "maxDepth" and v is None else v for k, v in chosen.items()}
        model = build(name, stats, settings).fit(ready)
        held = model.transform(check).withColumnRenamed("prediction", name)
        tried.append((chosen, scores_of(held, [name]).first()[metric]))
    ready.unpersist()
    check.unpersist()
    best = (max if metric == "r2" else min)(tried, key=lambda t: t[1])
    rows = [(str(chosen), float(score)) for chosen, score in tried]
    return best[0], best[1], spark.createDataFrame(rows, f"params string, {metric} double")


def pipeline(columns: Sequence[str], name: str, stats: LabelStats, params: Mapping | None = None) -> Pipeline:
    """Assembler, scaler and one MLlib model as a single persistable stage list."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        build(name, stats, params),
    ])
