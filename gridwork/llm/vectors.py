"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Numbers of a matrix that is worked on at a time.
PORTION = 1 << 20


def floored(vectors: DataFrame, scale: int, *carry: str) -> DataFrame:
    """The ``carry`` columns and x = floor(scale * embedding) (array<bigint>) of the rows whose
    embedding is not null and holds only finite numbers. What is beyond a long becomes its end."""
    unfit = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    given = only(vectors, *carry, "embedding").filter("embedding is not null")
    numbers = given.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    return numbers.filter(~F.exists("embedding", unfit)).select(
        *carry, F.transform("embedding", lambda v: F.floor(v * scale)).alias("x"))


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length, at most about PORTION numbers at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        step = max(PORTION // max(int(size), 1), 1)
        for at in range(0, len(every), step):
            rows = every[at:at + step]
            yield int(size), rows, flat[starts[rows][:, None] + np.arange(size)].astype(np.int64).reshape(len(rows), size)


def fits_long(x: int) -> bool:
    return -2 ** 63 <= x < 2 ** 63


def exact(matrix: np.ndarray, most: int) -> np.ndarray:
    """The matrix in a type in which whole numbers up to ``most`` are exact: 64 bits, or Python's numbers."""
    return matrix if most < 2 ** 62 else matrix.astype(object)


def largest(matrix: np.ndarray) -> int:
    """The largest absolute value of whole numbers; 0 if there are none."""
    return max(int(matrix.max()), -int(matrix.min())) if matrix.size else 0
