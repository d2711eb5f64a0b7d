"""op13: whitened components of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import whitening
from .rows import table

NAME = "op13_embedding_whitening"
#: Eigenvectors are beyond SQL.
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
