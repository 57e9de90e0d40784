"""Exact k-nearest-neighbour regression without a cross join.

Rows are assigned to the nearest of some pivots, more of them for more rows. A query's k-th
nearest of the sampled rows around its nearest pivot bounds how far its k-th neighbour can be;
cells whose ring around the pivot or whose box lies wholly beyond that bound hold no neighbour
and are skipped. What is left is compared in blocks: a crowded cell is cut into blocks of
bounded size on both sides, so no task ever holds a whole cell, and only k candidates per query
and block leave a task. Inside a block
one matrix product gives all distances but for rounding; pairs that rounding cannot rule out
are computed again from differences, and these distances alone count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS, MOST_PIVOTS = 64, 1024
ROWS_A_PIVOT = 1024  # training rows for each pivot, between these numbers of pivots
SAMPLED, AROUND = 16, 64  # sampled rows a pivot, and those of all of them that lie nearest to a pivot
SAMPLE_VALUES = 1 << 21  # numbers that the sample holds at most, if that leaves PIVOTS pivots
BLOCK_ROWS = 16384
PAIRS = 4_000_000  # distances held at once
GROUPS = 256  # parts of a block whose least distances bound the k-th one


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, computed from differences so that equal vectors give 0."""
    out = np.empty((len(rows), len(points)))
    step = max(1, int(4e6 // max(1, points.size)))
    for start in range(0, len(rows), step):
        gap = rows[start : start + step, None, :] - points[None, :, :]
        out[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _closest(asked: np.ndarray, stocked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``stocked``, distance) of the ``k`` nearest, ties to the earlier stocked row.

    Infinite or missing components take the plain way: they have no bound on rounding.
    """
    middle = stocked.mean(axis=0)
    a, s = asked - middle, stocked - middle
    lengths, far = (a * a).sum(axis=1), (s * s).sum(axis=1)
    if not (np.isfinite(lengths).all() and np.isfinite(far).all()):
        gaps = _distances(asked, stocked)
        best = gaps.argsort(axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(asked)), best.shape[1])
        return rows, best.ravel(), gaps[rows, best.ravel()]
    # Moving both to the middle and the product of d terms round by less than this, even where all is far from the origin.
    slack = 16 * (asked.shape[1] + 8) * np.finfo(float).eps * (
        lengths + far.max() + (asked * asked).sum(axis=1) + (stocked * stocked).sum(axis=1).max())
    found = []
    groups = min(len(stocked), max(GROUPS, 2 * k))
    edges = np.arange(groups) * len(stocked) // groups
    step = max(1, PAIRS // len(stocked))
    for start in range(0, len(asked), step):
        part = slice(start, start + step)
        squares = a[part] @ s.T
        squares *= -2
        squares += far
        squares += lengths[part, None]
        least = np.minimum.reduceat(squares, edges, axis=1)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] if k <= groups else np.full(len(squares), np.inf)
        rows, picks = np.nonzero(squares <= (bound + 2 * slack[part])[:, None])
        gaps = np.empty(len(rows))
        some = max(1, PAIRS // asked.shape[1])
        for first in range(0, len(rows), some):
            cut = slice(first, first + some)
            gap = asked[start + rows[cut]] - stocked[picks[cut]]
            gaps[cut] = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((picks, gaps, rows))
        rows, picks, gaps = rows[order], picks[order], gaps[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < k
        found.append((start + rows[kept], picks[kept], gaps[kept]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _loose(rows: np.ndarray, known: dict, k: int) -> np.ndarray:
    """Which cells can hold one of the ``k`` nearest of each row, from the distances to pivots alone."""
    gaps = _distances(rows, known["pivot"])
    far = gaps + known["outer"]
    by_reach = far.argsort(axis=1)
    covered = known["rows"][by_reach].cumsum(axis=1) >= k
    first = np.where(covered.any(axis=1), covered.argmax(axis=1), far.shape[1] - 1)
    bound = far[np.arange(len(rows)), by_reach[np.arange(len(rows)), first]]
    near = np.maximum(gaps - known["outer"], known["inner"] - gaps)
    return near <= (bound * (1 + 1e-9) + 1e-12)[:, None]


def _reached(rows: np.ndarray, known: dict, k: int) -> np.ndarray:
    """Which cells can hold one of the ``k`` nearest of each row. ``known`` has cells (``pivot``, ``rows``, ``inner`` and ``outer``
    distance, corners ``low`` and ``high`` of the box) and ``around`` them the places of sampled rows in ``sample``.

    Infinite or missing numbers, or fewer than ``k`` sampled rows, take the plain way.
    """
    pivot, outer = known["pivot"], known["outer"]
    lengths, far = (rows * rows).sum(axis=1), (pivot * pivot).sum(axis=1)
    if known["around"].shape[1] < k or not all(np.isfinite(x).all() for x in (lengths, far, outer, known["sample"])):
        return _loose(rows, known, k)
    squares = lengths[:, None] + far - 2 * (rows @ pivot.T)
    slack = (16 * (rows.shape[1] + 8) * np.finfo(float).eps * (lengths + far.max()))[:, None]  # the product rounds by less
    gap = rows[:, None, :] - known["sample"][known["around"][squares.argmin(axis=1)]]
    bound = np.partition(np.sqrt((gap * gap).sum(axis=2)), k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12
    least, most = np.sqrt(np.maximum(squares - slack, 0)), np.sqrt(np.maximum(squares, 0) + slack)
    hits = np.maximum(least - outer, known["inner"] - most) <= bound[:, None]
    asked, cells = np.nonzero(hits)
    some = max(1, PAIRS // rows.shape[1])
    for start in range(0, len(asked), some):
        a, c = asked[start : start + some], cells[start : start + some]
        off = np.maximum(np.maximum(known["low"][c] - rows[a], rows[a] - known["high"][c]), 0)
        hits[a, c] = np.sqrt((off * off).sum(axis=1)) <= bound[a]
    return hits


def nearest(
    train: DataFrame, query: DataFrame, k: int = 5, key: str = "id", vector: str = "features",
    target: str = "y", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest training rows of each query: ``(key, neighbour, distance, y)``.

    Equal distances go to the smaller training key. ``pivots`` is their least number.
    """
    spark = train.sparkSession
    left = query.select(key, F.col(vector).cast("array<double>").alias("v"))
    right = train.select(
        F.col(key).alias("neighbour"), F.col(vector).cast("array<double>").alias("v"),
        F.col(target).cast("double").alias("y"),
    )
    rows, width = right.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    pivots = max(pivots, min(MOST_PIVOTS, rows // ROWS_A_PIVOT, SAMPLE_VALUES // (SAMPLED * max(1, width or 1))))
    order = F.xxhash64("neighbour")
    chosen = right.orderBy(order, "neighbour").limit(pivots * SAMPLED).select("v").collect()  # bounded by pivots
    if not chosen:
        kind = dict(query.dtypes)[key]
        return spark.createDataFrame([], f"{key} {kind}, neighbour {kind}, distance double, y double")
    sample = np.array([row["v"] for row in chosen], dtype="float64")
    centres = spark.sparkContext.broadcast(sample[:pivots])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot = centres.value
        far = (pivot * pivot).sum(axis=1)
        for batch in batches:
            if len(batch):
                v = _matrix(batch["v"])
                step = max(1, PAIRS // len(pivot))
                cell = np.concatenate([(far - 2 * (v[i : i + step] @ pivot.T)).argmin(axis=1) for i in range(0, len(v), step)])
                gap = v - pivot[cell]
                yield batch.assign(cell=cell, radius=np.sqrt((gap * gap).sum(axis=1)))

    schema = ", ".join(f"{n} {t}" for n, t in right.dtypes) + ", cell int, radius double"
    placed = right.mapInPandas(assign, schema)
    full = array_to_vector(F.transform("v", lambda x: F.coalesce(x, F.lit(float("nan")))))
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("radius").alias("inner"), F.max("radius").alias("outer"),
        Summarizer.metrics("min", "max").summary(full).alias("box"),
    ).orderBy("cell").collect()  # one row per pivot
    held = np.array([c["cell"] for c in cells])
    gaps = _distances(sample[:pivots][held], sample)
    shape = spark.sparkContext.broadcast({
        "cell": held, "rows": np.array([c["rows"] for c in cells]), "pivot": sample[:pivots][held],
        "inner": np.array([c["inner"] for c in cells]), "outer": np.array([c["outer"] for c in cells]),
        "low": np.array([c["box"]["min"].toArray() for c in cells]), "high": np.array([c["box"]["max"].toArray() for c in cells]),
        "sample": sample, "around": np.argsort(gaps, axis=1, kind="stable")[:, :AROUND].astype(np.int32),
    })

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shape.value
        step = max(1, PAIRS // (4 * len(known["cell"]) + AROUND * known["pivot"].shape[1]))
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch["v"])
            parts = [_reached(v[i : i + step], known, k) for i in range(0, len(v), step)]
            yield batch.assign(cells=[known["cell"][row].tolist() for part in parts for row in part])

    schema = ", ".join(f"{n} {t}" for n, t in left.dtypes) + ", cells array<int>"
    routed = left.mapInPandas(route, schema).withColumn("cell", F.explode("cells")).drop("cells")
    demand = {r["cell"]: r["rows"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).collect()}

    def cut(rows: int) -> int:
        return max(1, -(-rows // block_rows))

    sizes = [
        (c["cell"], cut(c["rows"]), cut(demand.get(c["cell"], 1))) for c in cells if c["cell"] in demand
    ]
    plan = F.broadcast(spark.createDataFrame(sizes, "cell int, blocks int, chunks int"))  # one row per pivot
    block = F.pmod(F.xxhash64("neighbour"), F.col("blocks")).cast("int")
    chunk = F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")
    tiles = ["cell", "block", "chunk"]
    stock = placed.join(plan, "cell").select(
        "neighbour", "v", "y", "cell", block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    asks = routed.join(plan, "cell").select(
        key, "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        chunk.alias("chunk"),
    )

    def compare(asked: pd.DataFrame, stocked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stocked):
            return pd.DataFrame({key: [], "neighbour": [], "distance": [], "y": []})
        stocked = stocked.sort_values("neighbour")
        rows, picks, gaps = _closest(_matrix(asked["v"]), _matrix(stocked["v"]), k)
        return pd.DataFrame({
            key: asked[key].to_numpy()[rows], "neighbour": stocked["neighbour"].to_numpy()[picks],
            "distance": gaps, "y": stocked["y"].to_numpy()[picks],
        })

    kinds = dict(left.dtypes) | dict(right.dtypes)
    found = asks.groupBy(*tiles).cogroup(stock.groupBy(*tiles)).applyInPandas(
        compare, f"{key} {kinds[key]}, neighbour {kinds['neighbour']}, distance double, y double"
    )
    place = F.row_number().over(W.partitionBy(key).orderBy("distance", "neighbour"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def knn_regression(
    train: DataFrame, query: DataFrame, k: int = 5, key: str = "id", vector: str = "features",
    target: str = "y", **options,
) -> DataFrame:
    """Prediction per query: neighbours weighted by 1/distance; exact hits alone when there are any."""
    found = nearest(train, query, k, key, vector, target, **options)
    exact = F.col("distance") == 0
    weight = F.try_divide(F.lit(1.0), F.col("distance"))
    return found.groupBy(key).agg(
        F.coalesce(
            F.avg(F.when(exact, F.col("y"))), F.sum(weight * F.col("y")) / F.sum(weight)
        ).alias("y_pred")
    )
