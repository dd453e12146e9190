"""Sums of number vectors that many tasks hold a part of.

A task gives its part of a vector as one binary value (little-endian numbers).
Parts are added in a tree: groups of ``fan_in`` parts meet in one task, then
their sums, so no task ever holds more than ``fan_in`` vectors, however many
tasks there were, and the driver sees sums only.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions that run in tasks travel in the closure: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_IN = 16


def packed(vector: np.ndarray, dtype: str = "<f8") -> bytes:
    """A vector as a binary value."""
    return np.ascontiguousarray(vector, dtype=dtype).tobytes()


def unpacked(value: bytes, dtype: str = "<f8") -> np.ndarray:
    """The vector of a binary value."""
    return np.frombuffer(bytes(value), dtype=dtype)


def tree_sum(parts: DataFrame, keys: list[str], n_parts: int, part: str = "part", value: str = "value", dtype: str = "<f8",
             fan_in: int = FAN_IN) -> DataFrame:
    """``keys`` and ``value``: the sum of the vectors of each key.

    ``part`` numbers the parts from 0 to ``n_parts`` - 1 (a key need not have
    all, and one part may hold several rows of a key); vectors of a key have one
    length. Rows with a null vector add nothing. No rows: no sums.
    """
    schema = T.StructType([*(parts.schema[k] for k in keys), T.StructField(part, T.LongType()), T.StructField(value, T.BinaryType())])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for v in group.column(value):
            x = np.frombuffer(v.as_py(), dtype=dtype)
            total = x.copy() if total is None else np.add(total, x, out=total)
        row = [group.column(k).slice(0, 1) for k in keys] + [group.column(part).slice(0, 1), pa.chunked_array([pa.array([total.tobytes()], pa.binary())])]
        return pa.table(row, names=schema.names)

    left = max(1, n_parts)
    out = parts.where(F.col(value).isNotNull()).select(*keys, F.col(part).cast("long").alias(part), value)
    while True:
        left = -(-left // fan_in)
        out = out.withColumn(part, F.floor(F.col(part) / fan_in)).groupBy(*keys, part).applyInArrow(add, schema)
        if left <= 1:
            return out.select(*keys, value)
