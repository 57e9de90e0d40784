"""Shards through fixed virtual slots.

A record belongs to one of ``SLOTS`` virtual slots, by a hash of its id and text; the repeats of a row that alone would
outweigh a slot are dealt over all slots. Bytes are summed per slot, and a versioned map gives every slot a shard: version 1 takes the slots from the heaviest to the lightest and puts
each into the shard with the fewest bytes; a later version edits the one before it, moving slots out of
overfull shards only. The map has ``SLOTS`` rows whatever the data's size, so it is one folded array row. With a path, every version is kept there and the last one is what the
next run edits.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qualitylab.llm.shared import written

SLOTS = 4096
#: A rebalanced map moves slots out of shards that hold more than this share above the mean.
SLACK = 0.02


def record_key(id_col: Column, text: Column) -> Column:
    """What a record's slot follows from: its id and text, so that rows without an id or with a common one spread too."""
    return F.xxhash64(id_col, text)


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``records`` (with ``key`` and ``size``) as a written table with ``vslot``: the key's slot, but for keys of several rows that hold more
    than a mean slot's bytes, whose rows are dealt one by one. There are at most ``slots`` such keys."""
    own = F.pmod(F.col("key"), F.lit(slots)).cast("int")
    rows = written(records.withColumns({"vslot": own, "row": F.monotonically_increasing_id()}), "records")
    mean = rows.agg((F.sum("size") / slots).alias("mean")).scalar()
    full = rows.groupBy("vslot").agg(F.sum("size").alias("held")).where(F.col("held") > mean).select("vslot")
    heavy = (rows.join(F.broadcast(full), "vslot", "left_semi").groupBy("key")  # at most slots rows; so are the heavy keys
             .agg(F.sum("size").alias("held"), F.count("*").alias("n")).where((F.col("held") > mean) & (F.col("n") > 1)))
    dealt = rows.join(F.broadcast(heavy.select("key", F.lit(True).alias("heavy"))), "key", "left")
    vslot = F.when(F.col("heavy"), F.pmod(F.xxhash64("key", "row"), F.lit(slots)).cast("int")).otherwise(F.col("vslot"))
    return written(dealt.withColumn("vslot", vslot).drop("heavy", "row"), "slotted")


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot``, ``bytes`` and ``n`` of every slot, empty ones too, from rows of ``vslot`` and ``size``."""
    loads = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    zero = F.lit(0).cast("long")
    return every.join(loads, "vslot", "left").select("vslot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("n", zero).alias("n"))


def _in_one_row(loads: DataFrame, *more: str) -> DataFrame:
    """The slots, heaviest first, as one array: SLOTS short entries."""
    entry = F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", *more)
    return loads.agg(F.array_sort(F.collect_list(entry)).alias("slots"))


def _lightest(loads: Column) -> Column:
    """Index of the first smallest entry."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _added(loads: Column, shard: Column, bytes_: Column) -> Column:
    return F.transform(loads, lambda load, i: F.when(i == shard, load + bytes_).otherwise(load))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: ``version``, ``vslot``, ``shard``."""
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("owner"))
    dealt = F.aggregate("slots", start, lambda s, slot: F.struct(
        _added(s["loads"], _lightest(s["loads"]), slot["bytes"]).alias("loads"),
        F.array_append(s["owner"], _lightest(s["loads"])).alias("owner")), lambda s: s["owner"])
    pairs = F.explode(F.arrays_zip(F.transform("slots", lambda s: s["vslot"]).alias("vslot"), dealt.alias("shard")))
    return _in_one_row(loads).select(pairs.alias("p")).select(F.lit(1).alias("version"), "p.vslot", "p.shard")


def rebalanced(old: DataFrame, loads: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """The next version of a map for the loads as they are now and ``shards`` shards (not fewer than before).

    Slots are taken from the heaviest to the lightest; one leaves its shard only while that shard holds
    more than ``slack`` above the mean, and goes to the lightest shard if it still fits there. All other slots stay.
    """
    rows = loads.join(old.select("vslot", "shard", "version"), "vslot")
    one = rows.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "shard"))).alias("slots"),
        F.max("version").alias("version"), F.sum("bytes").alias("all"))
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(
        "slots", F.lit(0).cast("long"), lambda a, s: a + F.when(s["shard"] == k, s["bytes"]).otherwise(F.lit(0))))
    most = (F.col("all") / shards * (1 + slack)).alias("most")
    one = one.select("slots", "version", "all", most, held.alias("held"))

    def move(state: Column, slot: Column) -> Column:
        now, to = state["loads"], _lightest(state["loads"])
        moves = (F.element_at(now, slot["shard"] + 1) > F.col("most")) & (F.array_min(now) + slot["bytes"] <= F.col("most"))
        target = F.when(moves, to).otherwise(slot["shard"])
        change = F.when(moves, slot["bytes"]).otherwise(F.lit(0))
        loads_ = _added(_added(now, slot["shard"], -change), to, change)
        return F.struct(loads_.alias("loads"), F.array_append(state["owner"], target).alias("owner"))

    start = F.struct(F.col("held").alias("loads"), F.array().cast("array<int>").alias("owner"))
    owner = F.aggregate("slots", start, move, lambda s: s["owner"])
    pairs = F.explode(F.arrays_zip(F.transform("slots", lambda s: s["vslot"]).alias("vslot"), owner.alias("shard")))
    return one.select((F.col("version") + 1).alias("version"), pairs.alias("p")).select("version", "p.vslot", "p.shard")


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of the map kept under ``path``; None if there is none."""
    try:
        every = spark.read.parquet(path)
    except AnalysisException:  # nothing has been written there
        return None
    last = every.agg(F.max("version")).first()[0]
    return None if last is None else every.where(F.col("version") == last).select("version", "vslot", "shard")


def current_map(loads: DataFrame, shards: int, path: str | None) -> DataFrame:
    """The map for these loads: version 1, or, where ``path`` keeps earlier versions, the last one edited. A version that moves nothing
    is not written again."""
    spark = loads.sparkSession
    if path is None:
        return written(first_map(loads, shards), "slot-map")
    old = stored_map(spark, path)
    if old is None:
        first_map(loads, shards).write.mode("append").parquet(path)
    else:
        new = written(rebalanced(old, loads, shards), "slot-map")
        if not new.select("vslot", "shard").exceptAll(old.select("vslot", "shard")).isEmpty():
            new.write.mode("append").parquet(path)
    return stored_map(spark, path)


def positions(records: DataFrame, slot_map: DataFrame, loads: DataFrame, order: list[str]) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, the gapless place in the shard: rows are numbered inside their
    virtual slot and begin where the shard's earlier virtual slots end. No window is larger than a virtual slot."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    begins = loads.join(slot_map, "vslot").withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy(*order))
    return (records.withColumn("inside", inside)
            .join(F.broadcast(begins.select("vslot", "shard", "begin")), "vslot")  # SLOTS rows
            .withColumn("slot", (F.col("begin") + F.col("inside") - 1).cast("long")).drop("inside", "begin"))


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text",
            map_path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and
    ``grown_shard`` (null under this law).

    Null and empty texts have size 1 and checksum 0. Repeated rows each get a place of their own. Rows without an id, with an
    id that many share, and with equal texts spread over the shards like any others: equal texts stay together only where
    their ids are equal too and they fit a slot. Other columns are not read. Under ``map_path`` the map's versions are kept: the first run writes version 1, a later
    one, also with more shards, moves only slots out of overfull shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = slotted(docs.select(
        F.col(id_col).alias("id_"), record_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), record_key(F.col(id_col), text).alias("key")), slots)
    loads = written(slot_loads(records, slots), "slot-loads")
    slot_map = current_map(loads, shards, map_path).select("vslot", "shard")
    placed = positions(records, slot_map, loads, ["id_", "text_crc32", "size"])
    return placed.select(F.col("id_").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
