"""Vector code compression: product codes by Lloyd's rounds over members that stay where they are.

A vector is cut into parts. A part lives in the partition of (position, entry, salt), where ``entry`` is the codebook
entry it belongs to; ``salt`` splits entries with many members. Each round, the owners of an entry sum their resident
members, the codebooks (a few hundred integers) are replaced, and every member is judged where it is. Only parts
whose nearest entry has changed migrate, in the next round's shuffle; the others are never moved again. Resident
members are persisted on the executors; lost ones are built again from the written base table and the rounds' shuffles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.llm.shared import written
from qualitylab.llm.vectors import finite, matrix, numbered, scaled, width_of

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Salts of an entry: at least SALTS, and so many that a salt of an entry that holds every part keeps to MEMBERS.
SALTS, MEMBERS = 16, 1 << 18
OWNER = ["position", "entry", "salt"]


def nearest(position: Column, part: Column, codebooks: np.ndarray) -> Column:
    """``to``, the entry of the position's codebook nearest to the part (ties: the lower), and ``error``, the squared distance."""
    kind = pa.struct([("to", pa.int32()), ("error", pa.int64())])

    @arrow_udf("struct<to:int,error:bigint>")
    def judged(positions: pa.Array, parts: pa.Array) -> pa.Array:
        where, x = positions.to_numpy(), matrix(parts, codebooks.shape[2], np.int64)
        to, error = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        for p in np.unique(where):
            own = where == p
            apart = np.stack([((x[own] - entry) ** 2).sum(axis=1) for entry in codebooks[p]], axis=1)
            to[own] = apart.argmin(axis=1)
            error[own] = apart.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(to), pa.array(error)], fields=list(kind))

    return judged(position, part)


def in_place(members: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The resident members, each with its nearest entry ``to`` and ``error``. Persisted; nothing is shuffled."""
    return (members.withColumn("judged", nearest(F.col("position"), F.col("part"), codebooks))
            .select(*members.columns, "judged.to", "judged.error").persist())


def settled(resident: DataFrame, partitions: int) -> DataFrame:
    """The members after a round's moves: those that keep their entry stay in their partitions, the others migrate to
    their new owner. Partitions of arrivals are put together with partitions of residents where they lie, which is no shuffle,
    so their number stays. Movers are a written table, so a plan reads the residents once and does not double with every round."""
    kept = ["row_", "of", "part"]
    stay = resident.filter("to = entry").select(*OWNER, *kept)
    moved = written(resident.filter("to <> entry").select("position", F.col("to").alias("entry"), "salt", *kept), "movers")
    return stay.union(moved.repartition(partitions, *OWNER)).coalesce(partitions)


def updated(codebooks: np.ndarray, members: DataFrame) -> np.ndarray:
    """Every used entry becomes floor(sum / count) of its members. Owners sum what is resident; the driver gets one row an entry."""
    sums = [F.sum(F.col("part")[i].cast("long")).alias(f"s{i}") for i in range(codebooks.shape[2])]
    owned = members.groupBy(*OWNER).agg(F.count("*").alias("n"), *sums)
    names = ["n", *(f"s{i}" for i in range(codebooks.shape[2]))]
    whole = owned.groupBy("position", "entry").agg(*(F.sum(name).alias(name) for name in names))
    after = codebooks.copy()
    for row in whole.collect():  # parts * entries rows
        after[row.position, row.entry] = [row[name] // row.n for name in names[1:]]
    return after


def first_codebooks(base: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the ``entries`` smallest ids (fewer rows: fewer entries); equal ids in order of their vectors, null ids last."""
    first = base.orderBy(F.asc_nulls_last("id_"), "vector").select("vector").limit(entries).collect()
    return np.array([r.vector for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def trained(base: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The resident members under the final codebooks (persisted), and these."""
    partitions = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(SALTS, math.ceil(base.count() / MEMBERS))
    codebooks, step = first_codebooks(base, parts, entries, width), width // parts
    cut = F.array(*(F.slice("vector", i * step + 1, step) for i in range(parts)))
    cells = base.select("row_", F.struct("id_", "label_").alias("of"), F.posexplode(cut).alias("position", "part"))
    cells = cells.withColumn("of", F.when(F.col("position") == 0, F.col("of")))  # one of a vector's parts carries its id
    cells = cells.withColumn("judged", nearest(F.col("position"), F.col("part"), codebooks))
    salt = F.pmod(F.xxhash64("row_"), F.lit(salts)).cast("int").alias("salt")
    members = cells.select("position", F.col("judged.to").alias("entry"), salt, "row_", "of", "part")
    members = members.repartition(partitions, *OWNER).persist()
    before = resident = members
    for done in range(rounds):
        after = updated(codebooks, members)
        if done and np.array_equal(after, codebooks):
            break  # from now on nothing moves
        codebooks = after
        resident = in_place(members, codebooks)
        members = settled(resident, partitions)  # writes the movers, and so fills what is resident
        before.unpersist()
        before = resident
    return resident, codebooks


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
               id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each usable row: id, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another
    length than that of the smallest id; a length that ``parts`` does not divide is an error, also a component that scales
    to 2^25 or more. Repeated rows and ids are coded each; null ids are coded and come last in the order of ids.
    Null labels count together. Fewer rows than ``entries`` make fewer entries; an empty table gives an empty result.
    Other columns are not read.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("1 to 256 entries and at least one round")
    usable = rows.filter(finite(F.col(vector_col)) & (F.size(vector_col) > 0))
    base = numbered(usable.select(F.col(id_col).alias("id_"), F.col(label_col).alias("label_"), scaled(F.col(vector_col), scale).alias("vector")),
                    "vectors")
    width = width_of(base)
    if width % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {width} components")
    base = base.filter(F.size("vector") == width)
    if not width:
        nothing = base.select(F.col("id_").alias(id_col), F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")))
        return nothing.withColumn("codebooks_sha256", F.lit(""))
    resident, codebooks = trained(base, width, parts, entries, rounds)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("position", "to"))), lambda s: F.lpad(F.lower(F.hex(s["to"])), 2, "0"))
    coded = resident.groupBy("row_").agg(F.max("of").alias("of"), F.array_join(in_order, "").alias("code"), F.sum("error").alias("error"))
    coded = written(coded.select("of.*", "code", "error"), "codes")
    resident.unpersist()
    by_label = coded.groupBy(F.col("label_").alias("same")).agg(F.sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label_").eqNullSafe(F.col("same")))
            .select(F.col("id_").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256")))
