"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a class body for Java, Python and RE2 patterns.
SPACE = r"\x20\x09-\x0D"

ROW = "__row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """Every column in one struct, so that no name of the input meets a computed one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def field(name: str) -> Column:
    return F.col(ROW).getField(name)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[field(c).alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def within_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small; else left to a shuffled join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df
