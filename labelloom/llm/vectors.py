"""Vectors of an Arrow list column as rows of a numpy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Doubles of a block of rows that a task holds at once.
BLOCK_VALUES = 1 << 20


def plain(df: DataFrame, column: str) -> DataFrame:
    """df, whose vectors have elements that numpy reads as they are: float and double stay, any other kind becomes double."""
    return df if df.schema[column].dataType.simpleString() in ("array<float>", "array<double>") else df.withColumn(column, F.col(column).cast("array<double>"))


def lengths(column: pa.Array) -> np.ndarray:
    """Elements of each row's list; -1 for null."""
    return column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros to width; a null row, and a null element, is NaN."""
    size = lengths(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    out[size < 0] = np.nan
    return out


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest element first, so that no square overflows or vanishes. Rows of zeros become NaN."""
    with np.errstate(all="ignore"):
        rows = rows / np.abs(rows).max(axis=1, initial=0)[:, None]
        return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
