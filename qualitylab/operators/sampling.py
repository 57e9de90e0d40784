"""Splits, folds and rebalancing, driven by a hash of (key, seed): the same rows fall on
the same side however the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylab.functions import augment
from qualitylab.operators import ordering

_PREFIX = 5  # hex digits: about a million slices of the hash range


def hash_key(key: str, seed: int = 42) -> Column:
    """Uniform hex string of (key, seed)."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def quantile_bins(df: DataFrame, column: str, q: int = 5, name: str = "bin") -> DataFrame:
    """Quantile bin of each row: right-closed, equal edges merged; a constant column is one bin."""
    found = ordering.exact_quantiles(df, [], column, [i / q for i in range(q + 1)], "e").first()
    edges = sorted(set(found["e"])) if found else []
    value = F.col(column)
    number = F.when(value.isNotNull(), F.lit(0))
    for i, edge in enumerate(edges[1:-1], start=1):
        number = F.when(value > edge, i).otherwise(number)
    return df.withColumn(name, number.cast("int"))


def random_split(df: DataFrame, test_size: float = 0.2, key: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Bernoulli split by hash threshold: no shuffle."""
    cut = f"{round((1 - test_size) * 16**8):08x}"
    below = F.substring(hash_key(key, seed), 1, 8) < cut
    return df.where(below), df.where(~below)


def stratified_split(
    df: DataFrame, target: str = "composite_score", test_size: float = 0.2, key: str = "id",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``round((1 - test_size)·n)`` rows of each quantile bin train; the rest validate.

    Bins are few and huge, so rows are not ranked per bin. The hash of the last training
    row is found by counting hash slices first and ranking only the one slice it lies in;
    the split itself is then a filter.
    """
    distinct = df.select(target).where(F.col(target).isNotNull()).distinct().limit(5).count()
    binned = quantile_bins(df, target, max(1, min(5, distinct)), "_bin").withColumn(
        "_hash", hash_key(key, seed)
    )
    slim = binned.select("_bin", "_hash", F.substring("_hash", 1, _PREFIX).alias("_slice"))
    slices = slim.groupBy("_bin", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by_bin = W.partitionBy("_bin")  # at most 16**_PREFIX rows per bin
    upto = by_bin.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    wanted = F.bround((1 - test_size) * F.sum("_n").over(by_bin))
    edge = (
        slices.select("_bin", "_slice", "_n", wanted.alias("_want"), F.sum("_n").over(upto).alias("_upto"))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select("_bin", "_slice", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    place = F.row_number().over(W.partitionBy("_bin").orderBy("_hash"))  # one slice per bin
    last = (
        slim.join(F.broadcast(edge), ["_bin", "_slice"])  # at most one row per bin
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_need"))
    )
    limits = {row["_bin"]: row["_hash"] for row in last.select("_bin", "_hash").collect()}  # <= 5 rows
    trains = F.lit(False)
    for number, limit in limits.items():
        trains = trains | ((F.col("_bin") == number) & (F.col("_hash") <= limit))
    return (
        binned.where(trains).drop("_bin", "_hash"),
        binned.where(~F.coalesce(trains, F.lit(False))).drop("_bin", "_hash"),
    )


def positional_split(df: DataFrame, test_size: float = 0.2, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The first ``int((1 - test_size)·n)`` rows in key order train. Needs only the key at the cut."""
    numbered = ordering.with_running_sum(df.select(key), [key], None, "_row")
    rows = numbered.count()
    cut = int(rows * (1 - test_size))
    edge = numbered.where(F.col("_row") == cut).select(key).first()
    if edge is None:
        return df, df.limit(0)
    return df.where(F.col(key) < edge[0]), df.where(F.col(key) >= edge[0])


def with_folds(df: DataFrame, k: int = 5, key: str = "id", seed: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1: contiguous in key order, or by hash when a seed is given."""
    if seed is not None:
        slot = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("long")
        return df.withColumn("fold", (slot % k).cast("int"))
    numbered = ordering.with_running_sum(df.select(key), [key], None, "_row")
    # Contiguous folds need only the key at each cut; the first n % k folds are one longer.
    rows = numbered.count()
    sizes = [rows // k + (1 if i < rows % k else 0) for i in range(k)]
    cuts = [sum(sizes[:i]) for i in range(1, k)]
    at = {r["_row"]: r[key] for r in numbered.where(F.col("_row").isin(cuts)).collect()}  # k-1 rows
    fold = F.lit(0)
    for i, cut in enumerate(cuts, start=1):
        if cut in at:
            fold = F.when(F.col(key) >= at[cut], i).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))


def oversampled(
    df: DataFrame, category: str = "category", min_samples: int = 10, key: str = "id", seed: int = 42
) -> DataFrame:
    """Extra rows, drawn with replacement, that lift each small category to ``min_samples``.

    Only categories under ``min_samples`` rows are touched, so each window holds fewer.
    """
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("_n")).where(
        (F.col("_n") < min_samples) & F.col(category).isNotNull()
    )
    order = W.partitionBy(category).orderBy(hash_key(key, seed), key)
    members = df.join(counts.select(category), category, "left_semi").withColumn(
        "_row", F.row_number().over(order)
    )
    drawn = augment.drawn(augment.root(F.col(category), seed, "row"), F.col("_draw")) % F.col("_n") + 1
    draws = counts.select(
        category, "_n", F.explode(F.sequence(F.lit(1), F.lit(min_samples) - F.col("_n"))).alias("_draw")
    ).select(category, "_draw", drawn.cast("int").alias("_row"))
    return draws.join(members, [category, "_row"]).drop("_row")


def balance_categories(
    df: DataFrame, category: str = "category", text_col: str = "response", min_samples: int = 10,
    key: str = "id", seed: int = 42,
) -> DataFrame:
    """All rows plus reworded extra rows of small categories, tagged ``category_balance``."""
    extra = oversampled(df, category, min_samples, key, seed)
    reworded = augment.synonym_replacement(F.col(text_col), F.concat_ws("|", F.col(key).cast("string"), "_draw"), 2, seed)
    extra = extra.withColumn(text_col, reworded).drop("_draw").withColumn(
        "augmentation_strategy", F.lit("category_balance")
    )
    return df.unionByName(extra, allowMissingColumns=True)
