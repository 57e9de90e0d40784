"""What the operators on vectors share: usable rows with a number each, and Arrow lists as NumPy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.llm.shared import written

#: Scaled components stay below this, so that squared distances and inner products fit 64 bits.
MOST = 1 << 25


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither nulls nor NaN or infinities."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """Each component as the integer floor(factor * x). A component of MOST or more is an error that names the bound."""

    def whole(x: Column) -> Column:
        big = F.raise_error(F.lit(f"scaled vector components must be below {MOST}"))
        y = F.lit(float(factor)) * x.cast("double")
        return F.when(F.abs(y) < MOST, F.floor(y)).otherwise(big).cast("int")

    return F.transform(vector, whole)


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a written table with ``row_``, a number of its own for each row; the same whoever reads it again."""
    return written(rows.withColumn("row_", F.monotonically_increasing_id()), label)


def width_of(table: DataFrame) -> int:
    """Length of the vector of the smallest id (null ids last; equal ids: the smallest vector); 0 without rows."""
    first = table.orderBy(F.asc_nulls_last("id_"), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    return first[0].n if first else 0


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """Arrow lists of ``width`` numbers each as one matrix, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)
