"""Membership in a table of bands of any size, overlapping and open-ended, by an equi-join.

All bounds of the table cut the line into elementary intervals; a value's interval is found by
binary search in the bounds.  Over the intervals stands a binary tree: a band is cut into the few
nodes that tile it (two per level at most), a value lies under one node per level.  Rows meet where
the node is the same, each band at exactly one node of a value's path, so a row comes once per band
that holds it and no row is compared with a band that does not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds that may be shipped to every task: 8 MB of them.
MOST_BOUNDS = 1 << 20
#: Nodes are numbered within their level; the level stands above these bits.
_LEVEL = 32
#: Stands for a null value, which only bands without any bound hold.
_NULL_NODE = -1


def bounds_of(bands: DataFrame, lo: str = "lo", hi: str = "hi") -> np.ndarray:
    """Values at which some band begins, or has ended."""
    cut = F.explode(F.array_compact(F.array(F.col(lo).cast("long"), F.col(hi).cast("long") + 1)))
    found = bands.select(cut.alias("b")).distinct().limit(MOST_BOUNDS + 1).toPandas()["b"].to_numpy(np.int64)
    if len(found) > MOST_BOUNDS:
        raise ValueError(f"more than {MOST_BOUNDS} different bounds")
    return np.sort(found)


def _levels(bounds: np.ndarray) -> int:
    return max(1, int(len(bounds)).bit_length())


def tiles(first: int, end: int) -> list[int]:
    """Tree nodes that tile the elementary intervals from ``first`` up to ``end``."""
    out, level = [], 0
    while first < end:
        if first & 1:
            out.append((level << _LEVEL) + first)
            first += 1
        if end & 1:
            end -= 1
            out.append((level << _LEVEL) + end)
        first, end, level = first >> 1, end >> 1, level + 1
    return out


def band_nodes(lo: Column, hi: Column, bounds: np.ndarray) -> Column:
    """Nodes of a band; a null bound is open, a band that ends before it begins has none."""

    @F.pandas_udf("array<bigint>")
    def of(los: pd.Series, his: pd.Series) -> pd.Series:
        out = []
        for low, high in zip(los, his):
            first = 0 if pd.isna(low) else int(np.searchsorted(bounds, int(low), "right"))
            end = len(bounds) + 1 if pd.isna(high) else int(np.searchsorted(bounds, int(high) + 1, "right"))
            out.append(tiles(first, end) + [_NULL_NODE] * (pd.isna(low) and pd.isna(high)))
        return pd.Series(out)

    return of(lo.cast("string"), hi.cast("string"))


def value_nodes(value: Column, bounds: np.ndarray) -> Column:
    """The node of each level above a value's elementary interval."""
    levels = np.arange(_levels(bounds) + 1)

    @F.pandas_udf("array<bigint>")
    def of(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        at = np.searchsorted(bounds, values[known].to_numpy(np.int64), "right").astype(np.int64)
        nodes = iter(list((levels << _LEVEL) + (at[:, None] >> levels)))
        return pd.Series([next(nodes) if k else np.array([_NULL_NODE]) for k in known])

    return of(value.cast("long"))


def join_bands(rows: DataFrame, value: str, bands: DataFrame, *, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows beside the columns of every band with ``lo <= value <= hi``; a null bound is not tested."""
    bounds = bounds_of(bands, lo, hi)
    placed = bands.withColumn("__node", F.explode(band_nodes(F.col(lo), F.col(hi), bounds)))
    looking = rows.withColumn("__node", F.explode(value_nodes(F.col(value), bounds)))
    return looking.join(placed, "__node").drop("__node")


def count_by_band(rows: DataFrame, value: str, bands: DataFrame, *sums: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The columns of every band with ``n`` and the totals of ``sums`` over the values it holds.

    Rows are added up by value first, so a value held by a third of them is one row in the join.
    """
    names = {c: f"__sum_{c}" for c in sums}
    per_value = rows.groupBy(F.col(value).alias("__value")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(n) for c, n in names.items()]
    )
    met = join_bands(per_value, "__value", bands, lo=lo, hi=hi)
    totals = met.groupBy(*bands.columns).agg(
        F.sum("__n").alias("n"), *[F.sum(n).alias(c) for c, n in names.items()]
    )
    keys = {c: f"__key_{c}" for c in bands.columns}
    same = F.lit(True)
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    found = bands.distinct().join(totals.withColumnsRenamed(keys), same, "left")
    return found.select(
        *bands.columns, F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums]
    )
