"""Rows with a usable vector, and their integer coordinates.

A vector is usable if it is there, has no null or non-finite entry and as many entries as most vectors of
the table (the larger number of two that are equally frequent), one at least; others can't be compared with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Coordinates beyond this stay at it, so that sums of products of 2,048 dimensions fit in a long.
LARGEST = (1 << 26) - 1


def coordinates(vector: Column, largest: int | None = None) -> Column:
    """floor(256 * entry) of every entry as longs, entries taken as doubles."""

    def one(c: Column) -> Column:
        value = F.floor(c.cast("double") * F.lit(256.0))
        return (value if largest is None else F.greatest(F.least(value, F.lit(largest)), F.lit(-largest))).cast("bigint")

    return F.transform(vector, one)


def usable(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable vector, and its number of entries (0: no such row)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    whole = rows.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(F.forall(column, finite))
    sizes = whole.groupBy(F.size(column).alias("n")).agg(F.count("*").alias("rows"))
    top = sizes.orderBy(F.desc("rows"), F.desc("n")).first()  # one row per length
    dims = top.n if top else 0
    return whole.filter(F.size(column) == dims), dims


def matrix(column: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    """A batch's lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims).astype(kind, copy=False)
