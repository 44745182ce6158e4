"""Integer vectors from columns of floating-point arrays, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components beyond this are refused: sums of their squares would not fit a long.
LARGEST = 1 << 24


def complete(vector: Column) -> Column:
    """Whether there is a vector, and no component of it is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; an error beyond ``LARGEST``."""
    def one(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(value) <= LARGEST, value).otherwise(
            F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))
        ).cast("int")

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The arrays of a column, none NULL, as rows of 64-bit integers; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        # All partial sums are whole numbers that a double holds.
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
