from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded so that engines that sum in another order agree."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def add(fn: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = Entry(name, lambda spark, path: rounded(fn(spark, path)), sql)
        return fn

    return add


def entries() -> dict[str, Entry]:
    return dict(_ENTRIES)
