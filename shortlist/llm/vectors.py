"""Embedding rows as integer vectors: which rows take part, and how they become arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry is stored as the floor of so many times its value.
STEPS = 256.0
LONG = (1 << 63) - 1


def whole_vector(vector: Column) -> Column:
    """False for a null vector and for one with a null, NaN or infinite entry."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def integers(vector: Column) -> Column:
    """Entries as longs; beyond a long's range they stay at its end."""
    return F.transform(vector, lambda c: F.floor(F.lit(STEPS) * c.cast("double")))


def integer_rows(df: DataFrame, vector: str, **kept: Column) -> tuple[DataFrame, int]:
    """Rows with a whole vector: the columns ``kept`` and ``x``; and the length of every ``x``.

    Vectors shorter than the longest are filled up with zeros.
    """
    rows = df.filter(whole_vector(F.col(vector))).select(
        *[c.alias(n) for n, c in kept.items()], integers(F.col(vector)).alias("x")
    )
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))
    return rows, most or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch's list column, every list of length ``d``, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def pack(x: np.ndarray) -> tuple[bytes, str]:
    """The smallest whole-number form that holds ``x``, and its type."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


def unpack(data: bytes, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, d)


def largest(x: np.ndarray) -> int:
    """Largest absolute value as a Python number."""
    return max(-int(x.min()), int(x.max())) if x.size else 0
