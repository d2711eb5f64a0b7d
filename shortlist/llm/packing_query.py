"""op9: all ``documents`` packed into sequences of 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing
from .rows import table

NAME = "op9_packing"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = packing.public_vocabulary(packing.VOCABULARY)
    return packing.pack(table(spark, folder, "documents"), vocabulary, keep_ids=False).drop("ids")
