"""Exact medians of groups of any size in two passes, without a histogram of a whole group.

The first pass counts a group's values in ``RANGES`` ranges of equal width between its least and
its largest; the ranges that hold the middle ranks are known from these counts.  The second pass
counts the distinct values of those ranges alone.  Both passes combine inside each task.

Groups are few and large: what is known of each, its bounds and its middle ranges, goes to every
task.  The rows never do, however small their file is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def _ranks(n: Column) -> tuple[Column, Column]:
    """0-based ranks whose mean is the median."""
    return F.floor((n - 1) / 2), F.ceil((n - 1) / 2)


def medians(rows: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """``by``, ``median``: of the non-null values of each group, each counted ``weight`` times.

    Groups without a value are not returned.
    """
    by = list(by)
    kept = rows.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("__v"), (F.lit(1) if weight is None else weight).cast("long").alias("__w")
    )
    bounds = kept.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__w").alias("__n"))
    place = (F.col("__v") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * RANGES
    ranged = _together(kept, bounds, by).withColumn("__r", F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(RANGES - 1)))
    counts = ranged.groupBy(*by, "__r").agg(F.sum("__w").alias("__c"), F.first("__n").alias("__n"))
    chosen = _holding(counts, by, "__r").select(*by, "__r", "__before")
    inside = (
        _together(ranged, chosen, [*by, "__r"])
        .groupBy(*by, "__v")
        .agg(F.sum("__w").alias("__c"), F.first("__n").alias("__n"), F.first("__before").alias("__first"))
    )
    # counts start at the first chosen range
    w = Window.partitionBy(*by)
    held = _holding(inside.withColumn("__first", F.min("__first").over(w)), by, "__v", F.col("__first"))
    low, high = _ranks(F.col("__n"))
    at = lambda rank: F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__upto")), F.col("__v")))
    return held.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def _together(rows: DataFrame, others: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows beside the one row of ``others`` that agrees on ``by``, nulls included; ``others`` is broadcast."""
    renamed = others.select(*[F.col(c).alias(f"__by_{c}" if c in by else c) for c in others.columns])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(F.broadcast(renamed), on).drop(*[f"__by_{c}" for c in by])


def _holding(counts: DataFrame, by: Sequence[str], order: str, first: Column | None = None) -> DataFrame:
    """Rows whose counts cover a middle rank, with the number of values ``__before`` and ``__upto``."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = F.sum("__c").over(w) + (F.lit(0) if first is None else first)
    low, high = _ranks(F.col("__n"))
    return (
        counts.withColumn("__upto", upto)
        .withColumn("__before", F.col("__upto") - F.col("__c"))
        .filter((F.col("__upto") > low) & (F.col("__before") <= high))
    )
