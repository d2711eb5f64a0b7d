"""Portable hash order.

md5 of a text key gives the same order on every engine and every partitioning,
so shuffles, samples and splits are repeatable and a lost task redoes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of an order key in bits (15 hex digits, always positive in a bigint).
ORDER_BITS = 60


def text_key(*parts) -> Column:
    """Join literals and columns with ``:``; numbers must be integers."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hex_long(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def order_key(*parts) -> Column:
    """Uniform 60-bit order key of the joined parts."""
    return hex_long(F.md5(text_key(*parts)), 1, 15)


def hash_bucket(modulus: int | Column, *parts) -> Column:
    """Bucket in ``[0, modulus)`` from the first 32 bits of md5."""
    return hex_long(F.md5(text_key(*parts)), 1, 8) % modulus


def unit_interval(*parts) -> Column:
    """Uniform double in [0, 1) with 52 random bits."""
    return hex_long(F.md5(text_key(*parts)), 1, 13).cast("double") / F.lit(float(2**52))
