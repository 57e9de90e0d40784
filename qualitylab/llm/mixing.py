"""Mixing sources to target weights, block by block.

Each source's documents form one stream of words, cut into blocks of ``BLOCK`` words. The mix has as many block
slots as the targets ask for. The slots are dealt to the output shards by one pseudorandom permutation, so a
shard's counts of the sources are a multinomial draw, held to the mix's exact totals. A source's slots run
through its blocks in passes, each pass in an order of its own, given by a pseudorandom permutation of the block
numbers; slots and blocks are then joined by (source, block). A source is never sorted or held in one place:
streams are numbered inside ``CELLS`` hash cells, and cells by their sums.

Spark takes slots for as few as the sources that they are exploded from, and would broadcast them; their joins are
named merge joins, as is that of cells and rows, whose file is far smaller than the rows in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qualitylab.llm.shared import words_in, written

BLOCK, CELLS, SHARD_SLOTS, MOST, SEED, ROUNDS = 64, 1024, 4096, 3, 11, 12


def water_filled(sources: DataFrame, weight: Column, most: int = MOST) -> DataFrame:
    """``sources`` (one row each, with ``source_size``) and their ``target``: all words shared by weight, no source
    above ``most`` times its size, the excess shared again by weight among the others.

    By size per weight, sources reach their limit in order; the level of the rest follows from running sums.
    """
    rows = sources.withColumn("weight_", weight).withColumn("limit_", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("limit_") / F.col("weight_"), "source_")
    every = Window.partitionBy()
    rows = (rows
            .withColumn("spent_", F.coalesce(F.sum("limit_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("left_", F.sum("weight_").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level_", (F.sum("source_size").over(every) - F.col("spent_")) / F.col("left_")))
    free = F.col("limit_") > F.col("level_") * F.col("weight_")
    level = F.max(F.when(free, F.col("level_"))).over(every)
    return (rows.withColumn("target", F.when(free, level * F.col("weight_")).otherwise(F.col("limit_")))
            .drop("weight_", "limit_", "spent_", "left_", "level_"))


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` (0 to ``size`` - 1) in a pseudorandom permutation that ``key`` chooses. Every round
    pairs each place with its mirror image at a random point, and swaps the two or not."""

    def swapped(place: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(r, *key) - place, size)
        coin = F.xxhash64(-1 - r, *key, F.greatest(place, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(place)

    return F.aggregate(F.array(*map(F.lit, range(rounds))), index.cast("long"), swapped)


def streams(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``id_``, ``source_`` (``=`` and the name, or nothing for null), ``cell`` and ``size`` of every row."""
    return docs.select(
        F.col(id_col).alias("id_"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_"),
        F.pmod(F.xxhash64(id_col), F.lit(CELLS)).cast("int").alias("cell"),
        words_in(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: ``source_``, ``source_size``, ``target``, ``blocks``, ``draws`` and ``before`` (the slots of the
    sources ahead of it). Sources weigh 1, 2, 3 and so on again, by code point, null last."""
    sources = sizes.groupBy("source_").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source_") == "", "source_")
    weight = (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double")
    rows = water_filled(sources, weight)
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("blocks", blocks).withColumn("draws", draws.cast("long"))
    before = F.sum("draws").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("slots", F.sum("draws").over(Window.partitionBy()))


def drawn(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: one row for each slot, with ``shard``, ``slot``, ``source_`` and ``block``."""
    last = F.floor((F.col("draws") - 1) / SHARD_SLOTS)
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, else few short rows become one task
    chunks = (sources.filter("draws > 0").select("source_", "blocks", "draws", "before", "slots",
                                                 F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
              .repartition(tasks, "source_", "chunk"))
    first = F.col("chunk") * SHARD_SLOTS
    until = F.least(first + SHARD_SLOTS, F.col("draws")) - 1
    rows = chunks.select("source_", "blocks", "before", "slots", F.explode(F.sequence(first, until)).alias("draw"))
    rows = rows.withColumn("pass", F.floor(F.col("draw") / F.col("blocks")).cast("long"))
    rows = rows.withColumn("block", permuted(F.pmod("draw", "blocks"), F.col("blocks"), F.lit(seed), F.col("source_"), F.col("pass")))
    rows = rows.withColumn("place", permuted(F.col("before") + F.col("draw"), F.col("slots"), F.lit(seed)))
    return rows.select(F.floor(F.col("place") / SHARD_SLOTS).alias("shard"), F.pmod("place", F.lit(SHARD_SLOTS)).alias("slot"),
                       "source_", "block")


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with its source's figures and ``begin``, the row's first word in the stream of its source."""
    cells = sizes.groupBy("source_", "cell").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source_").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (cells.withColumn("cell_begin", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
             .join(sources.select("source_", "source_size", "target"), "source_").drop("held"))
    inside = Window.partitionBy("source_", "cell").orderBy(F.xxhash64("id_"), "id_", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(cells.hint("merge"), ["source_", "cell"])
            .withColumn("begin", F.col("cell_begin") + F.col("inside")).drop("cell_begin", "inside"))


def pieces(rows: DataFrame) -> DataFrame:
    """``rows`` of at least one word, once for each block they reach into: ``block``, ``skip`` (words of the row before
    it) and ``words`` in it."""
    end = F.col("begin") + F.col("size")
    blocks = F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((end - 1) / BLOCK)))
    cut = rows.filter("size > 0").withColumn("block", blocks)
    start = F.greatest(F.col("begin"), F.col("block") * BLOCK)
    return cut.withColumn("skip", start - F.col("begin")).withColumn("words", F.least(end, (F.col("block") + 1) * BLOCK) - start)


def shard_counts(mix: DataFrame) -> DataFrame:
    """How many of each shard's slots every source fills: the multinomial draw, given the mix's totals."""
    return mix.groupBy("shard", "source_").agg(F.count("*").alias("slots"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: ``shard`` and ``slot``, in which ``words`` words of the row with this id stand, from its word number ``skip`` on.
    A slot holds one block, which is a part of a row or several rows."""
    sizes = written(streams(docs, id_col, source_col, text_col), "sizes")
    sources = written(targets(sizes), "sources")
    cut = pieces(packed(sizes, sources)).select("id_", "source_", "block", "skip", "words")
    return (drawn(sources).hint("merge").join(cut, ["source_", "block"])
            .select("shard", "slot", F.col("id_").alias(id_col), "skip", "words"))


def mixed_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``size`` in words, ``source_size``, ``target`` of its source and ``taken``,
    the words that the mix takes of it, repeats counted.

    Null and empty texts have size 0 and are never taken; null sources are one source, the last. A source's
    words come within a block or so of its target; a pass takes a block once, so no row gives more
    than 3 times its size. Repeated rows each have a place in the stream. Other columns are not read. One window runs
    over the sources (a row each), none over documents of more than one cell.
    """
    sizes = written(streams(docs, id_col, source_col, text_col), "sizes")
    sources = written(targets(sizes), "sources")
    rows = packed(sizes, sources)
    placed = drawn(sources).groupBy("shard", "source_", "block").agg(F.count("*").alias("slots"))
    taken = placed.groupBy("source_", "block").agg(F.sum("slots").alias("times"))
    keys = ["id_", "source_", "size", "begin", "source_size", "target"]
    used = (pieces(rows).select(*keys, "block", "words").join(taken.hint("merge"), ["source_", "block"], "left")
            .groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")))
    none = rows.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return used.union(none).select(F.col("id_").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, each row as often as the mix takes it: its taken words over its size, rounded. A rest
    is settled by a hash of id and text, so reruns agree. Rows without words are left as they are."""
    taken = mixed_sources(docs.withColumn("id_mix_", F.xxhash64(id_col, text_col)), "id_mix_", source_col, text_col)
    share = taken.groupBy("id_mix_").agg(F.max("size").alias("size_mix_"), F.avg("taken").alias("taken_mix_"))
    joined = docs.withColumn("id_mix_", F.xxhash64(id_col, text_col)).join(share, "id_mix_")
    exact = F.col("taken_mix_") / F.col("size_mix_")
    chance = F.pmod(F.xxhash64(F.lit(SEED), "id_mix_"), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("size_mix_") == 0, 1).otherwise(F.floor(exact + chance)).cast("int")
    return joined.withColumn("id_mix_", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
