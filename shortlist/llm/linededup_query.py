"""op7: ``documents`` without the passages that earlier documents have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup
from .rows import field, table

NAME = "op7_line_dedup"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = F.transform("cuts", lambda c: F.concat_ws(":", c["a"].cast("string"), c["b"].cast("string")))
    return linededup.dedup(docs).select(
        field("doc_id").alias("doc_id"),
        F.size("cuts").cast("long").alias("n_runs"),
        "words_cut",
        F.array_join(spans, ",").alias("line_runs"),
        "text",
    )
