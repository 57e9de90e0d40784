"""Two regressors that MLlib lacks: AdaBoost.R2 over its trees, and linear support vector regression.

Both follow the fit and transform shape of MLlib's: ``fit`` takes ``(id, y, features)`` rows, ``transform`` adds ``prediction``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.session import pin

#: Rounds of boosting whose weights are one expression; then the weights are written, so that plans stay short.
ROUNDS_AT_ONCE = 8


def weighted_median(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """The first of the sorted values at which half of the weight is reached."""
    pairs = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(float(w)).alias("w")) for v, w in zip(values, weights, strict=True)]))
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("v"))
    half = float(sum(weights)) / 2

    def step(s: Column, p: Column) -> Column:
        upto = s["upto"] + p["w"]
        return F.struct(upto.alias("upto"), F.when(s["v"].isNull() & (upto >= half), p["v"]).otherwise(s["v"]).alias("v"))

    return F.aggregate(pairs, start, step, lambda s: s["v"])


@dataclass(frozen=True)
class AdaBoost:
    """AdaBoost.R2 with the linear loss: each tree is fitted to weighted rows, and rows that it misses weigh more in the next round.

    The weights are the trees' sample weights themselves (no weighted bootstrap), so a round is a tree and two aggregations,
    and reruns agree. Boosting ends early at a tree without any error, or at one whose weighted mean loss is 1/2 or more
    (such a tree is only kept if it is the first). Without rows ``fit`` raises ValueError.
    """

    rounds: int = 100
    max_depth: int = 3
    rate: float = 1.0
    seed: int = 42

    def fit(self, train: DataFrame) -> "AdaBoostModel":
        rows = train.select("y", "features").where("y is not null").withColumn("w", F.lit(1.0))
        trees, weights = [], []
        for turn in range(self.rounds):
            if turn % ROUNDS_AT_ONCE == 0:
                rows = pin(rows)
            learner = DecisionTreeRegressor(featuresCol="features", labelCol="y", weightCol="w", predictionCol="p",
                                            maxDepth=self.max_depth, seed=self.seed + turn)
            tree = learner.fit(rows)
            judged = tree.transform(rows).withColumn("e", F.abs(F.col("y") - F.col("p")))
            worst, missed, weight, n = judged.agg(
                F.max("e"), F.sum(F.col("w") * F.col("e")), F.sum("w"), F.count(F.lit(1))).first()
            loss = missed / weight / worst if worst > 0 else 0.0
            if loss == 0.0:
                trees, weights = [*trees, tree], [*weights, 1.0]
                break
            if loss >= 0.5:
                if not trees:
                    trees, weights = [tree], [1.0]
                break
            beta = loss / (1 - loss)
            trees.append(tree)
            weights.append(self.rate * float(np.log(1 / beta)))
            lighter = F.col("w") * F.pow(F.lit(beta), self.rate * (1 - F.col("e") / worst))
            # Kept near one on average, so that a long run does not end in denormal numbers.
            rows = judged.withColumn("w", lighter * (n / weight)).select("y", "features", "w")
        return AdaBoostModel(trees, weights)


@dataclass(frozen=True)
class AdaBoostModel:
    trees: list
    weights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, the weighted median of the trees' answers."""
        names = [f"_tree_{i}" for i in range(len(self.trees))]
        out = df
        for tree, name in zip(self.trees, names, strict=True):
            out = tree.copy().setPredictionCol(name).transform(out)
        return out.withColumn("prediction", weighted_median([F.col(n) for n in names], self.weights)).drop(*names)


#: Widths of the rounded corners of the loss, as parts of the target's deviation, one after another; Newton steps for each.
CORNERS, NEWTON_STEPS = (1.0, 0.1, 0.01, 1e-3), 40
#: Lengths of a Newton step that one scan tries.
LENGTHS = tuple(0.5**i for i in range(12))


def rounded_loss(residual: np.ndarray, epsilon: float, corner: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss beyond ``epsilon``, quadratic over the first ``corner``, with its first and second derivative by the residual."""
    over = np.abs(residual) - epsilon
    inside = (over > 0) & (over < corner)
    loss = np.where(over <= 0, 0.0, np.where(inside, over**2 / (2 * corner), over - corner / 2))
    slope = np.sign(residual) * np.clip(over / corner, 0, 1)
    return loss, slope, inside / corner


@dataclass(frozen=True)
class LinearSvr:
    """Linear support vector regression: ``1/2 |w|² + c · Σ max(0, |y - w·x - b| - epsilon)``, the intercept free of penalty.

    The loss's corners are rounded by an ever smaller width and each such problem is solved by Newton steps. A step is two scans:
    one sums gradient and curvature over the rows (one small matrix leaves a task), one the loss at all step lengths.
    The objective is at most ``c · rows · corner / 2`` above the least. Without rows ``fit`` raises ValueError.
    """

    c: float = 1.0
    epsilon: float = 0.1
    tolerance: float = 1e-9

    def fit(self, train: DataFrame) -> "LinearSvrModel":
        rows = train.select(F.col("y").cast("double").alias("y"), vector_to_array("features").alias("x")).where("y is not null")
        n, middle, deviation = rows.agg(F.count("y"), F.median("y"), F.stddev_pop("y")).first()
        if not n:
            raise ValueError("no row with a target to fit to")
        rows = rows.persist()
        try:
            size = rows.select(F.size("x")).first()[0]
            at = np.append(np.zeros(size), middle)
            penalty = np.append(np.ones(size), 0.0)
            for corner in CORNERS:
                at = self._settled(rows, at, penalty, corner * (deviation or 1.0))
        finally:
            rows.unpersist()
        return LinearSvrModel(at[:-1], float(at[-1]))

    def _settled(self, rows: DataFrame, at: np.ndarray, penalty: np.ndarray, corner: float) -> np.ndarray:
        for _ in range(NEWTON_STEPS):
            loss, slope, bend = self._sums(rows, at, corner)
            now = loss * self.c + penalty @ at**2 / 2
            back = penalty * at - self.c * slope
            curve = np.diag(penalty) + self.c * bend
            curve[np.diag_indices(len(at))] += 1e-10 * max(1.0, np.abs(curve).max())
            step = -np.linalg.solve(curve, back)
            if -(back @ step) <= self.tolerance * max(1.0, now):
                return at
            tried = np.array([at + length * step for length in LENGTHS])
            goals = self._losses(rows, tried, corner) * self.c + (tried**2 @ penalty) / 2
            if goals.min() >= now:
                return at
            at = tried[goals.argmin()]
        return at

    def _sums(self, rows: DataFrame, at: np.ndarray, corner: float) -> tuple[float, np.ndarray, np.ndarray]:
        size = len(at)

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            loss, slope, bend = rounded_loss(y - x @ at, self.epsilon, corner)
            return np.concatenate([[loss.sum()], x.T @ slope, ((x * bend[:, None]).T @ x).ravel()])

        found = _added(rows, of, 1 + size + size * size)
        return found[0], found[1:1 + size], found[1 + size:].reshape(size, size)

    def _losses(self, rows: DataFrame, tried: np.ndarray, corner: float) -> np.ndarray:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return rounded_loss(y[:, None] - x @ tried.T, self.epsilon, corner)[0].sum(axis=0)

        return _added(rows, of, len(tried))


def _added(rows: DataFrame, of, size: int) -> np.ndarray:
    """``of(x with a column of ones, y)`` summed over all rows: tasks sum their own, Spark sums the tasks' by place."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += of(np.column_stack([x, np.ones(len(x))]), batch["y"].to_numpy())
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "v": pa.array(total)})

    out = np.zeros(size)
    for row in rows.select("x", "y").mapInArrow(summed, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out


@dataclass(frozen=True)
class LinearSvrModel:
    coefficients: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, computed in the JVM."""
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b)
        return df.withColumn("prediction", F.aggregate(products, F.lit(self.intercept), lambda a, b: a + b))
