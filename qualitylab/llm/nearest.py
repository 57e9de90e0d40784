"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample: every node splits its sample rows into a few clusters until a node is small. Every row
then goes down to one leaf; a leaf's rows lie in blocks of bounded size. A query keeps the branches that it has not taken in a priority
queue by their distance and visits leaves in that order. How many leaves are visited is calibrated: for a bounded
set of probe rows the true neighbours are found by brute force over all rows, and visits are widened until the leaves
visited hold the target share of them. A query's first visits give it a floor for the others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.window import Window

from qualitylab.llm.shared import written
from qualitylab.llm.vectors import finite, matrix, numbered, width_of

#: Rows the tree is fitted on, branches of a node, sample rows of a node that is not split, rounds of k-means.
SAMPLE, BRANCHES, LEAF, STEPS = 16_384, 16, 64, 10
#: Probe rows of the calibration, and the share of their true neighbours that the visited leaves must hold.
PROBES, TARGET = 64, 0.98
#: Rows of one block of a leaf, queries of one block; share of the visits that the first, floor-giving round makes.
BLOCK, QUERIES, FIRST = 4096, 1024, 16
NEIGHBOURS, SEED = 5, 7
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled by a power of two first so that no square overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and its row of ``b`` in double precision: sums from the first component to the last, so that equal
    vectors get equal values wherever they stand."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) for x in (a, b))
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


@dataclass
class Tree:
    """Inner nodes 0, 1, ...: the centres of their children, and the children (``-1 - leaf`` for a leaf)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of ``x`` goes down to."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            branch = (x[rows] @ self.centres[node].T).argmax(axis=1)
            for b, child in enumerate(self.children[node]):
                own = rows[branch == b]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def best_bins_first(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, in the order in which a search for ``q`` visits them: always down the nearest branch not yet taken."""
        queue = [(0.0, 0 if self.centres else -1)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            apart = ((self.centres[node] - q) ** 2).sum(axis=1)
            for pair in zip(apart.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, pair)


def clusters(x: np.ndarray, k: int, chance: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` clusters of unit vectors; empty ones are left out."""
    centres = x[chance.choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        own = (x @ centres.T).argmax(axis=1)
        used = np.unique(own)
        sums = np.stack([x[own == c].sum(axis=0) for c in used])
        lengths = np.sqrt((sums * sums).sum(axis=1))[:, None]
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres[used])
    return centres[np.unique((x @ centres.T).argmax(axis=1))]


def grown(x: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES) -> Tree:
    """A tree for the unit vectors ``x``. Nodes whose rows cannot be told apart are leaves, whatever they hold."""
    tree, chance = Tree(), np.random.default_rng(SEED)

    def split(rows: np.ndarray) -> int:
        centres = clusters(x[rows], min(branches, math.ceil(len(rows) / leaf)), chance) if len(rows) > leaf else x[:0]
        if len(centres) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.centres)
        tree.centres.append(centres)
        tree.children.append([])
        own = (x[rows] @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            tree.children[node].append(split(rows[own == c]))
        return node

    split(np.arange(len(x)))
    return tree


def leaf_column(vector: Column, tree: Tree, width: int) -> Column:
    @arrow_udf("int")
    def leaf(vectors: pa.Array) -> pa.Array:
        return pa.array(tree.leaf_of(unit(matrix(vectors, width))), pa.int32())

    return leaf(vector)


def visited(vector: Column, tree: Tree, width: int, visits: int) -> Column:
    """The first ``visits`` leaves of each query."""

    @arrow_udf("array<int>")
    def found(vectors: pa.Array) -> pa.Array:
        return pa.array([list(islice(tree.best_bins_first(q), visits)) for q in unit(matrix(vectors, width))], pa.list_(pa.int32()))

    return found(vector)


def bins(base: DataFrame, tree: Tree, width: int) -> DataFrame:
    """All rows by leaf, in blocks: ``leaf``, ``chunk`` and ``entries``. A leaf with many rows, such as copies, has many blocks."""
    rows = written(base.withColumn("leaf", leaf_column(F.col("vector"), tree, width)), "leaves")
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = rows.join(F.broadcast(sizes), "leaf").withColumn("chunk", F.pmod(F.xxhash64("row_"), F.col("chunks")))  # at most SAMPLE leaves
    return written(rows.groupBy("leaf", "chunk").agg(F.collect_list(F.struct("row_", "id_", "vector")).alias("entries")), "bins")


def best_of(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, askers: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query index, row index, score) of each query's ``k`` best rows with at least its floor; its own row left out."""
    rough = unit(q) @ unit(x).T
    rough[askers[:, None] == rows[None, :]] = -np.inf
    least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    a, b = np.nonzero((rough >= np.maximum(least, floors)[:, None] - SLACK) & (rough > -np.inf))
    scores = cosines(q[a], x[b])
    order = np.lexsort((rows[b], ids[b, 1], ids[b, 0], -scores, a))
    a, b, scores = a[order], b[order], scores[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    kept = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
    return a[kept], b[kept], scores[kept]


def named(column: pa.Array) -> np.ndarray:
    """Ids as (null or not, value), so that they can be sorted with nulls last."""
    return np.array([(i is None, i or 0) for i in column.to_pylist()], np.int64).reshape(-1, 2)


SCORES = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def scored(q: np.ndarray, askers: np.ndarray, floors: np.ndarray, entries: pa.Array, width: int, k: int) -> pa.RecordBatch:
    rows, ids = entries.field("row_").to_numpy(), entries.field("id_")
    a, b, scores = best_of(matrix(entries.field("vector"), width), rows, named(ids), q, askers, floors, k)
    return pa.RecordBatch.from_arrays([pa.array(askers[a]), pa.array(rows[b]), ids.take(pa.array(b)), pa.array(scores)], schema=SCORES)


def in_order(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their ``rank``; ties by id, null last, then row."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def searched(leaves: DataFrame, asked: DataFrame, n: int, width: int, k: int) -> DataFrame:
    """``query``, ``row``, ``id`` and ``score``: the ``k`` best of every leaf block for each query (of ``n``) that visits the leaf."""
    group = F.pmod(F.xxhash64("row_"), F.lit(math.ceil(n / QUERIES)))
    blocks = (asked.withColumn("group", group).groupBy("leaf", "group")
              .agg(F.collect_list(F.struct("row_", "vector", "floor")).alias("asked")).select("leaf", "asked"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries, own in zip(batch["entries"], batch["asked"], strict=True):
                own = own.values
                yield scored(matrix(own.field("vector"), width), own.field("row_").to_numpy(), own.field("floor").to_numpy(), entries.values, width, k)

    return leaves.select("leaf", "entries").join(blocks, "leaf").select("entries", "asked").mapInArrow(tried, "query bigint, row bigint, id bigint, score double")


def true_neighbours(leaves: DataFrame, probes: np.ndarray, askers: np.ndarray, width: int, k: int) -> DataFrame:
    """The probes' ``k`` nearest of all rows, by brute force: each block of rows meets the (few) probes."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in batch["entries"]:
                yield scored(probes, askers, np.full(len(probes), -np.inf), entries.values, width, k)

    found = leaves.select("entries").mapInArrow(tried, "query bigint, row bigint, id bigint, score double")
    return in_order(found, k)


def calibrated(base: DataFrame, leaves: DataFrame, tree: Tree, width: int, k: int, target: float = TARGET) -> int:
    """How many leaves a search visits: widened from one until the probes' visited leaves hold ``target`` of their true neighbours."""
    drawn = base.orderBy(F.xxhash64(F.lit(SEED), "row_"), "row_").limit(PROBES).select("row_", "vector").collect()
    probes = np.array([r.vector for r in drawn], np.float64).reshape(len(drawn), width)
    truth = true_neighbours(leaves, probes, np.array([r.row_ for r in drawn], np.int64), width, k)
    of_row = truth.join(base.select(F.col("row_").alias("row"), "vector"), "row").select("query", leaf_column(F.col("vector"), tree, width).alias("leaf"))
    held: dict[int, list[int]] = {r.row_: [] for r in drawn}
    for r in of_row.collect():  # PROBES * k rows
        held[r.query].append(r.leaf)
    orders = {r.row_: list(tree.best_bins_first(q)) for r, q in zip(drawn, unit(probes), strict=True)}
    places = sorted(orders[row].index(leaf) for row, own in held.items() for leaf in own)
    visits = 1
    while visits < tree.leaves and sum(p < visits for p in places) < target * len(places):
        visits += 1
    return visits


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding",
                       target: float = TARGET, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` rows found nearest to every query by cosine, its own row left out.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do vectors of another length than
    that of the smallest id. Repeated rows are rows of their own; null ids are candidates that come last among ties. The
    tree sees at most ``sample`` rows, every row is indexed, and scores are exact; ``target`` is the recall to which the number of
    visited leaves is calibrated. Fewer candidates than ``k`` in the visited leaves give fewer rows. Other columns are not read.
    """
    full = finite(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)
    base = numbered(rows.filter(full).select(F.col(id_col).cast("long").alias("id_"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"),
                                             F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    width = width_of(base)
    base = base.filter(F.size("vector") == width)
    drawn = base.orderBy(F.xxhash64("row_"), "row_").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    if not len(drawn):
        return base.select(F.col("id_").alias("query_id"), F.lit(0).alias("rank"), F.col("id_").alias("vec_id"), F.lit(0.0).alias("score"))
    tree = grown(unit(matrix(drawn, width)), leaf)
    leaves = bins(base.select("row_", "id_", "vector"), tree, width)
    visits = calibrated(base, leaves, tree, width, k, target)
    queries = base.filter("asks")
    n, few = queries.count(), max(1, visits // FIRST)
    asked = written(queries.select("row_", "vector", F.posexplode(visited(F.col("vector"), tree, width, visits)).alias("at", "leaf")), "visits")
    unknown = F.lit(float("-inf"))
    near = written(in_order(searched(leaves, asked.filter(F.col("at") < few).withColumn("floor", unknown), max(n, 1), width, k), k), "near")
    floors = near.filter(F.col("rank") == k).select(F.col("query").alias("row_"), F.col("score").alias("floor_"))
    rest = asked.filter(F.col("at") >= few).join(floors, "row_", "left").withColumn("floor", F.coalesce("floor_", unknown))
    found = in_order(near.drop("rank").union(searched(leaves, rest, max(n, 1), width, k)), k)
    return (found.join(queries.select(F.col("row_").alias("query"), F.col("id_").alias("query_id")), "query")
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
