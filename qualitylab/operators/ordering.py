"""Exact global order at scale: row numbers, running sums, average ranks, quantiles.

A window without ``partitionBy`` (or with one hot group) puts its rows into one task.
Here rows are range-sorted over all tasks, pinned by a checkpoint, and numbered inside
their partition; per-partition totals (one row per sort partition) give the offsets.
Values are counted before sorting, so a value held by a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylab.functions.stats import correlation
from qualitylab.session import pin

_IN_PARTITION_BITS = 33  # monotonically_increasing_id: partition << 33 | row in partition


def with_running_sum(
    df: DataFrame, order_by: Sequence[str | Column], value: str | None = None, name: str = "before"
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows sorted before this one.

    Without ``value`` rows are counted, which gives the zero-based row number. The order
    must be total (end it with a unique key) for a repeatable result.
    """
    laid_out = pin(df.sort(*order_by).withColumn("_seq", F.monotonically_increasing_id()))
    laid_out = laid_out.withColumn("_part", F.shiftright("_seq", _IN_PARTITION_BITS))
    total = F.sum(value) if value else F.count(F.lit(1))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy("_part")
        .agg(total.alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    if value:
        inside = W.partitionBy("_part").orderBy("_seq").rowsBetween(W.unboundedPreceding, -1)
        local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    else:
        local = F.col("_seq").bitwiseAND((1 << _IN_PARTITION_BITS) - 1)
    return (
        laid_out.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")  # one row per sort partition
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_part", "_seq", "_local", "_offset")
    )


def counted(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row per group and value: its count ``n``, the rows sorted before it in its
    group (``low``) and the group's size (``size``). Null values and groups drop out.

    Rows are counted inside their sort partition, so no exchange has a group alone as its key. Only the
    first and the last group of a sort partition can reach beyond it; what those hold elsewhere is a table of
    at most two rows per sort partition.
    """
    present = F.col(value).isNotNull()
    for group in groups:
        present = present & F.col(group).isNotNull()
    counts = df.where(present).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    keys = ["_part", *groups]
    laid_out = pin(counts.sort(*groups, value).withColumn("_part", F.spark_partition_id()))
    held, earlier = W.partitionBy(*keys), W.partitionBy(*groups)
    before = lambda window, by: window.orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    inside = laid_out.withColumns({
        "low": F.coalesce(F.sum("n").over(before(held, value)), F.lit(0)), "size": F.sum("n").over(held),
    })
    split = laid_out.groupBy(*keys).agg(F.sum("n").alias("_held")).withColumns({
        "_pieces": F.count(F.lit(1)).over(earlier),
        "_size": F.sum("_held").over(earlier),
        "_low": F.coalesce(F.sum("_held").over(before(earlier, "_part")), F.lit(0)),
    }).where("_pieces > 1").drop("_pieces", "_held")
    return (
        inside.join(F.broadcast(split), keys, "left")  # at most two rows per sort partition
        .withColumns({"low": F.col("low") + F.coalesce("_low", F.lit(0)), "size": F.coalesce("_size", "size")})
        .drop("_part", "_size", "_low")
    )


def ranks_of(counts: DataFrame) -> DataFrame:
    """Add ``avg_rank`` to ``counted`` rows: ties share the mean of their ranks."""
    return counts.withColumn("avg_rank", F.col("low") + (F.col("n") + 1) / 2)


def quantiles_of(
    counts: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float],
    name: str = "quantiles",
) -> DataFrame:
    """Quantiles with linear interpolation from ``counted`` rows, one array per group."""

    def at(position: Column) -> Column:
        inside = (F.col("low") <= position) & (position < F.col("low") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    picks, answers = [], []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("size") - 1)
        picks += [at(F.floor(position)).alias(f"_f{i}"), at(F.ceil(position)).alias(f"_c{i}")]
        share = F.lit(float(p)) * (F.col("_rows") - 1)
        share = share - F.floor(share)
        answers.append(F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * share)
    picked = counts.groupBy(*groups).agg(F.max("size").alias("_rows"), *picks)
    return picked.select(*groups, F.array(*[a.cast("double") for a in answers]).alias(name))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rank of each distinct value in its group: ``(groups…, value, n, size, avg_rank)``."""
    return ranks_of(counted(df, groups, value)).drop("low")


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float],
    name: str = "quantiles",
) -> DataFrame:
    """Exact quantiles as one array column per group.

    Unlike ``percentile`` no group is gathered in one aggregation buffer.
    """
    return quantiles_of(counted(df, groups, value), groups, value, probabilities, name)


def exact_median(df: DataFrame, groups: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, groups, value, [0.5], "_q").select(
        *groups, F.col("_q")[0].alias(name)
    )


def placed(df: DataFrame, value: str, scopes: Mapping[str, Sequence[str]], name: str = "") -> DataFrame:
    """``df`` with each row's place by ``value`` in every scope (a name and its group columns; none: all rows): columns
    ``{name}{scope}_low`` (rows of its group that are smaller), ``_ties`` (equal, itself included) and ``_size`` (all).
    Null values must be dropped before; a row whose group is null gets nulls in that scope.

    The rows are sorted once for all scopes, equal values spread over as many partitions as they fill. Places are counted
    inside a partition; what the partitions before it hold of a group, and of the values that run over a border, are
    sums of at most three cells for each partition and combination of groups. No exchange has a value or a group as its key.
    """
    seq = F.monotonically_increasing_id()
    laid_out = pin(df.withColumn("_seq", seq).sort(value, "_seq").withColumn("_part", F.spark_partition_id()).drop("_seq"))
    borders = laid_out.groupBy("_part").agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    border = F.when((F.col(value) == F.col("_first")) | (F.col(value) == F.col("_last")), F.col(value))
    columns = list(dict.fromkeys(c for groups in scopes.values() for c in groups))
    cells = pin(
        laid_out.join(F.broadcast(borders), "_part")  # one row per sort partition
        .groupBy("_part", *columns, border.alias("_edge")).agg(F.count(F.lit(1)).alias("_n"))
    )
    rows = laid_out.repartition("_part")  # all windows below lie inside these partitions
    for scope, groups in scopes.items():
        by, out = list(groups), f"{name}{scope}"
        upto = lambda window: window.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        held = cells.groupBy("_part", *by).agg(F.sum("_n").alias("_n")).select(
            "_part", *by, F.coalesce(F.sum("_n").over(upto(W.partitionBy(*by))), F.lit(0)).alias("_before"),
            F.sum("_n").over(W.partitionBy(*by)).alias(f"{out}_size"),
        )
        over = W.partitionBy(*by, "_edge")
        ties = cells.where("_edge is not null").groupBy("_part", *by, "_edge").agg(F.sum("_n").alias("_n")).select(
            "_part", *by, F.col("_edge").alias(value), F.count(F.lit(1)).over(over).alias("_pieces"),
            F.sum("_n").over(over).alias("_all"), F.coalesce(F.sum("_n").over(upto(over)), F.lit(0)).alias("_earlier"),
        ).where("_pieces > 1").drop("_pieces")
        inside = W.partitionBy("_part", *by)
        rows = rows.withColumns({
            f"{out}_low": F.rank().over(inside.orderBy(value)) - 1,
            f"{out}_ties": F.count(F.lit(1)).over(W.partitionBy("_part", *by, value)),
        })
        rows = rows.join(held, ["_part", *by], "left").join(ties, ["_part", *by, value], "left")
        rows = rows.withColumns({
            f"{out}_low": (F.col("_before") + F.col(f"{out}_low") - F.coalesce("_earlier", F.lit(0))).cast("long"),
            f"{out}_ties": F.when(F.col("_before").isNotNull(), F.coalesce("_all", f"{out}_ties")).cast("long"),
        }).drop("_before", "_all", "_earlier")
    return rows.drop("_part")


def place_rank(prefix: str) -> Column:
    """Average rank from the columns of ``placed``: ties share the mean of their ranks."""
    return F.col(f"{prefix}_low") + (F.col(f"{prefix}_ties") + 1) / 2


def place_median(prefix: str, value: str) -> Column:
    """Aggregate: the median of ``value`` of a group, from the columns of ``placed``."""
    low, ties, last = F.col(f"{prefix}_low"), F.col(f"{prefix}_ties"), F.col(f"{prefix}_size") - 1
    at = lambda place: F.max(F.when((low <= place) & (place < low + ties), F.col(value)))
    return (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, name: str = "spearman_r") -> DataFrame:
    """Spearman's rho per group: the rows are sorted by ``x``, then, with their ranks, by ``y``."""
    rows = df.select(*groups, x, y).dropna()
    for side, column in (("_x", x), ("_y", y)):
        rows = placed(rows, column, {"": groups}, side).withColumn(f"{side}_rank", place_rank(side))
    return rows.groupBy(*groups).agg(correlation("_x_rank", "_y_rank").alias(name))


def top(df: DataFrame, k: int, *order_by: str | Column) -> DataFrame:
    """First ``k`` rows of an order; every task keeps only its own ``k``."""
    return df.orderBy(*order_by).limit(k)


def arg_max(df: DataFrame, name: str, metric: str, largest: bool = True) -> DataFrame:
    """The row with the best ``metric``, ties to the smaller name, as (name, metric)."""
    key = F.col(metric).desc_nulls_last() if largest else F.col(metric).asc_nulls_last()
    return top(df.select(name, metric), 1, key, F.col(name))
