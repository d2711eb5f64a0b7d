"""Corpus readers and writers: tab-separated files, line texts, exclusion lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One named column of a tab-separated file (gzip included), blanks and short rows dropped.

    A gzip file is one task to read, so its rows are spread out right after.
    """
    table = (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if column not in table.columns:
        raise ValueError(f"no column {column!r} in {path}; it has {table.columns}")
    out = table.select(F.trim(F.col(f"`{column}`")).alias("raw")).filter(F.length("raw") > 0)
    return out.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else out


def read_second_column(spark: SparkSession, path: str) -> DataFrame:
    """The same, for files known to hold the text second."""
    header = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if len(header.columns) < 2:
        raise ValueError(f"{path} has fewer than two columns")
    return read_column(spark, path, header.columns[1])


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Line texts without empty lines; a missing path is an error."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).filter(
        F.col("value") != ""
    )


def read_split(spark: SparkSession, shard: str, split: str, grouped: bool = False) -> DataFrame:
    """One split of a shard written by :func:`write_splits`."""
    column = "group_split" if grouped else "split"
    folder = f"{shard}/group_splits" if grouped else f"{shard}/splits"
    return spark.read.parquet(folder).filter(F.col(column) == split).drop(column)


def read_exclusions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of several lists, stripped, without blanks or repeats."""
    return (
        spark.read.text(list(paths))
        .select(F.trim("value").alias("canonical"))
        .filter(F.col("canonical") != "")
        .distinct()
    )


def write_splits(
    items: DataFrame, path: str, *, column: str = "split", mode: str = "errorifexists"
) -> None:
    """One folder per split; ``mode`` guards a shard that exists already."""
    items.write.mode(mode).partitionBy(column).parquet(path)


def write_lines(items: DataFrame, text: str, path: str, column: str = "split", mode: str = "errorifexists"):
    """Line-text form of the splits, one folder per split."""
    items.select(F.col(text).alias("value"), column).write.mode(mode).partitionBy(column).text(path)
