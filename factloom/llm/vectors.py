"""Tables of vectors: the whole-number form that operators 11 and 12 work on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components reach from -LARGEST to LARGEST after scaling; sums of squares of differences then fit a long.
LARGEST = (1 << 27) - 1


def whole(vectors: DataFrame, vector: str, out: str = "whole", scale: int = 256) -> DataFrame:
    """Rows of `vectors` with `out`, an array of floor(scale * component), each component as a double.

    Left out are rows with a null vector, with a null, NaN or infinite component, and rows with a component beyond
    LARGEST, whose distances and products would not fit a long. An empty vector is kept.
    """
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | ~F.abs(v).between(0.0, float("1.7976931348623157e308"))
    fine = vectors.filter(x.isNotNull()).filter(~F.exists(F.transform(x, lambda v: v.cast("double")), bad))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)))
    small = ~F.exists(F.transform(x, lambda v: F.abs(F.floor(v.cast("double") * float(scale)).cast("double"))), lambda v: v > float(LARGEST))
    return fine.filter(small).withColumn(out, scaled.cast("array<long>"))


def padded(length: Column, row: Column) -> Column:
    """An array of the given length at least: zeros behind."""
    return F.concat(row, F.array_repeat(F.lit(0).cast("long"), F.greatest(length - F.size(row), F.lit(0))))


def matrix(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column, all of `width` components, as a matrix."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """Each row times the Hadamard matrix of its length (a power of two), by sums and differences only: exact for whole
    numbers. Coefficient 0 is the sum of the row."""
    out, half = rows.copy(), 1
    n, width = rows.shape
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return out


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()
