"""Hard negatives by exact inner-product search in length buckets with sorted coordinate lists.

Rows lie in buckets of nearly equal length, and a bucket in blocks of bounded size; a block holds, for every coordinate, its rows in
order of that coordinate of their unit vectors. A search wants, for an anchor, the best rows with scores in a window. The
scores found in one block of the longest bucket give it a floor. With that floor a bucket is skipped where even a parallel vector of its
length would score too little. In a block, the floor bounds the angle to the anchor, the angle bounds the values that the anchor's
largest (focus) coordinates can take, and binary search in their lists gives the rows inside those ranges. The rows in
all ranges are verified by exact integer products.

Anchors are a stated query set: blocks of anchors meet blocks of rows. Nothing is dropped: floors and ranges only
skip what cannot be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.window import Window

from qualitylab.llm.shared import written
from qualitylab.llm.vectors import MOST, finite, matrix, numbered, scaled, width_of

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A bucket's shortest vector is at least SHRINK times its longest; rows of a block, anchors of a block, focus coordinates.
SHRINK, BLOCK, ANCHORS, FOCUS = 0.9, 2048, 1024, 6
#: What rounding may add to a bound.
SLACK = 1e-9
#: No score reaches these.
LEAST, GREATEST = -(1 << 62), 1 << 62


def by_coordinate(entries: Column, width: int) -> Column:
    """For each coordinate, the block's rows in order of its value in their unit vectors: ``width`` runs of 16-bit numbers, and the
    longest length."""
    kind = pa.struct([("lists", pa.binary()), ("longest", pa.float64())])

    @arrow_udf("struct<lists:binary,longest:double>")
    def listed(blocks: pa.Array) -> pa.Array:
        rows = []
        for block in blocks:
            unit, lengths = unit_vectors(matrix(block.values.field("vector"), width))
            rows.append({"lists": unit.argsort(axis=0, kind="stable").T.astype(np.uint16).tobytes(), "longest": float(lengths.max())})
        return pa.array(rows, kind)

    return listed(entries)


def unit_vectors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their lengths (zero rows stay zero), and the lengths."""
    lengths = np.sqrt((x * x).sum(axis=1))
    return x / np.where(lengths > 0, lengths, 1)[:, None], lengths


def length_index(base: DataFrame, width: int) -> DataFrame:
    """The blocks of every length bucket: ``bucket``, ``chunk``, ``entries``, ``lists`` and ``longest``."""
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    bucket = F.when(square > 0, F.floor(F.log(square) / (-2 * math.log(SHRINK)))).otherwise(-1).cast("int")
    rows = base.withColumn("bucket", bucket)
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = rows.join(F.broadcast(sizes), "bucket")  # lengths of 64-bit squares: some hundred buckets at most
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row_"), F.col("chunks")))
    blocks = rows.groupBy("bucket", "chunk").agg(F.collect_list(F.struct("row_", "id_", "label_", "vector")).alias("entries"))
    return written(blocks.withColumn("index", by_coordinate(F.col("entries"), width)).select("bucket", "chunk", "entries", "index.*"), "lists")


def feasible(q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each coordinate of a unit vector whose cosine to the unit vector ``q`` is at least ``cosine``."""
    side = np.sqrt(np.maximum(1 - q * q, 0) * max(1 - cosine * cosine, 0))
    low = np.where(q >= -cosine, q * cosine - side, -1.0)
    return low - SLACK, np.where(q <= cosine, q * cosine + side, 1.0) + SLACK


def in_ranges(unit: np.ndarray, lists: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray | None:
    """Rows whose values lie in the feasible ranges of all of ``q``'s focus coordinates; None if no range leaves anything out."""
    low, high = feasible(q, cosine)
    met, used = np.zeros(len(unit), np.uint8), 0
    for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
        order = lists[f]
        column = unit[order, f]
        first, last = np.searchsorted(column, low[f], "left"), np.searchsorted(column, high[f], "right")
        if last - first < len(order):
            met[order[first:last]] += 1
            used += 1
    return np.flatnonzero(met == used) if used else None


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``: in doubles where all sums stay below 2^53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_in_block(block: pa.StructScalar, asked: pa.StructScalar, width: int, same: bool, k: int) -> Iterator[tuple]:
    """(anchor, want, row, id, score) of each want's first ``k`` rows of the block."""
    entries, anchors = block["entries"].values, asked["anchors"].values
    x, q = matrix(entries.field("vector"), width), matrix(anchors.field("vector"), width)
    rows, labels = entries.field("row_").to_numpy(), np.array(entries.field("label_").to_pylist(), object)
    named = np.array([(i is None, i or 0) for i in entries.field("id_").to_pylist()])
    unit, lengths = unit_vectors(x)
    lists = np.frombuffer(block["lists"].as_py(), np.uint16).reshape(width, len(x))
    turned, sizes = unit_vectors(q)
    wants, longest = anchors.field("wants").to_pylist(), float(lengths.max())
    picked: list[np.ndarray | None] = []
    for i, own in enumerate(wants):
        floor, most = min(w["low"] for w in own), sizes[i] * longest * (1 + SLACK)
        if floor > most:
            picked.append(np.empty(0, np.int64))  # the whole block is too short
        else:
            picked.append(in_ranges(unit, lists, turned[i], floor / most) if floor > 0 else None)
    whole = [i for i, p in enumerate(picked) if p is None or 2 * len(p) > len(x)]
    scores = dict(zip(whole, products(q[whole], x), strict=True))
    for i, (own, label, anchor) in enumerate(zip(wants, anchors.field("label_").to_pylist(), anchors.field("row_").to_pylist(), strict=True)):
        at = np.arange(len(x)) if i in scores else picked[i]
        found = scores[i] if i in scores else products(q[i:i + 1], x[at])[0]
        fits = ((labels[at] == label) == same) & (rows[at] != anchor) & (found >= min(w["low"] for w in own))
        at, found = at[fits], found[fits]
        order = np.lexsort((rows[at], named[at, 1], named[at, 0], -found))
        at, found = at[order], found[order]
        for w in own:
            first, last = np.searchsorted(-found, [-w["high"], 1 - w["low"]])
            for j in range(first, min(last, first + k)):
                yield anchor, w["want"], int(rows[at[j]]), None if named[at[j], 0] else int(named[at[j], 1]), int(found[j])


def searched(index: DataFrame, anchors: DataFrame, wants: DataFrame, n_anchors: int, width: int, same: bool, k: int) -> DataFrame:
    """``anchor``, ``want``, ``rank``, ``row``, ``id`` and ``score``: each want's first ``k`` rows with the anchor's label (``same``) or
    another one and a score from ``low`` to ``high``. Highest scores first; ties by id (null last), then row."""
    own = wants.groupBy("row_").agg(F.collect_list(F.struct("want", "low", "high")).alias("wants"), F.min("low").alias("low"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    groups = math.ceil(n_anchors / ANCHORS)
    asked = (anchors.join(own, "row_").withColumn("group", F.pmod(F.xxhash64("row_"), F.lit(groups)))
             .groupBy("group").agg(F.collect_list(F.struct("row_", "label_", "vector", "wants")).alias("anchors"),
                                   F.min(F.when(F.col("low") > 0, F.try_divide("low", length)).otherwise(0)).alias("reach")))
    visits = index.select("bucket", "chunk", "longest", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    visits = visits.join(asked.select("group", "reach"), "group").filter(F.col("reach") <= F.col("longest") * (1 + SLACK))
    pairs = visits.select("bucket", "chunk", "group").join(index, ["bucket", "chunk"]).join(asked, "group")
    pairs = pairs.select(F.struct("entries", "lists").alias("block"), F.struct("anchors").alias("asked"))
    names = ["anchor", "want", "row", "id", "score"]

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.int32() if n == "want" else pa.int64()) for n in names])
        for batch in batches:
            for block, asked_ in zip(batch["block"], batch["asked"], strict=True):
                rows = list(best_in_block(block, asked_, width, same, k))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)] if rows
                                                 else [pa.array([], t) for t in kinds.types], schema=kinds)

    found = pairs.mapInArrow(tried, "anchor bigint, want int, row bigint, id bigint, score bigint")
    best = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_rows(index: DataFrame, anchors: DataFrame, wants: DataFrame, n_anchors: int, width: int, same: bool, k: int) -> DataFrame:
    """``searched`` over all blocks, with floors from one block of the longest bucket."""
    top = index.agg(F.max("bucket").alias("bucket"), F.lit(0).cast("long").alias("chunk"))
    one = written(index.join(F.broadcast(top), ["bucket", "chunk"], "left_semi"), "first-block")  # one row
    floors = (searched(one, anchors, wants, n_anchors, width, same, k).filter(F.col("rank") == k)
              .select(F.col("anchor").alias("row_"), "want", F.col("score").alias("floor")))
    raised = wants.join(floors, ["row_", "want"], "left").withColumn("low", F.greatest("low", "floor")).drop("floor")
    return searched(index, anchors, written(raised, "wants"), n_anchors, width, same, k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   window: tuple[int, int] = (30, 90), scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``: for every anchor and each of its
    ``positives`` best rows of the same label, the best ``negatives`` rows of other labels whose score is from window[0] to
    window[1] percent of the positive's.

    Rows whose label or vector is null, or whose vector holds null or non-finite components, take no part; neither do vectors of another
    length than that of the smallest id. A component that scales to 2^25 or more is an error, also a table whose
    products could pass 2^62. Repeated rows are rows of their own; an anchor's own row is never its positive. Null ids come
    last among ties, and rows with a null ``is_anchor`` are no anchors. No anchors or no rows: an empty result.
    """
    usable = rows.filter(finite(F.col(vector_col)) & (F.size(vector_col) > 0)).withColumn("label_", label).filter("label_ IS NOT NULL")
    base = numbered(usable.select(F.col(id_col).cast("long").alias("id_"), "label_", scaled(F.col(vector_col), scale).alias("vector"),
                                  F.coalesce(is_anchor, F.lit(False)).alias("asks")), "vectors")
    width = width_of(base)
    base = base.filter(F.size("vector") == width)
    largest = base.agg(F.max(F.array_max(F.transform("vector", F.abs))).alias("m"), F.count_if("asks").alias("n")).collect()[0]
    if (largest.m or 0) ** 2 * width >= GREATEST or (largest.m or 0) >= MOST:
        raise ValueError("inner products of these vectors could pass 2^62")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not largest.n:
        return base.select(*(F.lit(0).cast("int" if c == "rank" else "long").alias(c) for c in columns)).limit(0)
    index = length_index(base, width)
    anchors = written(base.filter("asks").select("row_", "id_", "label_", "vector"), "anchors")
    wants = anchors.select("row_", F.lit(1).alias("want"), F.lit(LEAST).cast("long").alias("low"), F.lit(GREATEST).cast("long").alias("high"))
    near = written(best_rows(index, anchors, wants, largest.n, width, True, positives), "positives")
    low = F.ceil(F.col("score") * window[0] / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = F.floor(F.col("score") * window[1] / F.lit(100).cast("decimal(3,0)")).cast("long")
    wants = written(near.select(F.col("anchor").alias("row_"), F.col("rank").alias("want"), low.alias("low"), high.alias("high")), "windows")
    far = best_rows(index, anchors, wants.filter("low <= high"), largest.n, width, False, negatives)
    pairs = near.select("anchor", F.col("rank").alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (far.select("anchor", "want", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["anchor", "want"]).join(anchors.select(F.col("row_").alias("anchor"), F.col("id_").alias("anchor_id")), "anchor")
            .select(*columns))
