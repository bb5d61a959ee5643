"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not all zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def width(rows: DataFrame) -> int:
    """The most frequent length of the vectors (the least of several); others take no part. 0 for an empty table."""
    found = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0].n if found else 0


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values, which Spark moves as a whole instead of by component."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, "<f8").tobytes())])


def unpacked(column: pa.Array, wide: int) -> np.ndarray:
    """The rows of ``packed``, also of a slice of it."""
    _, offsets, values = column.buffers()
    if not len(column):
        return np.zeros((0, wide))
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(values, "<f8", len(column) * wide, first).reshape(-1, wide)


def steps(count: int, wide: int, most: int = 1 << 26) -> range:
    """Starts of batches of at most so many bytes of vectors, and their length as the step."""
    return range(0, count, max(1, most // (8 * max(wide, 1))))
