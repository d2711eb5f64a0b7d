"""op4: documents that hold items of ``benchmark``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from .rows import table

NAME = "op4_benchmark_decontamination"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = [
        docs.select("doc_id", F.explode(decontaminate.hits(docs.text, docs, block)).alias("hit"))
        for block in decontaminate.blocks(table(spark, folder, "benchmark"))
    ]
    none = spark.createDataFrame([], f"doc_id long, hit {decontaminate.HITS[6:-1]}")
    return reduce(DataFrame.unionByName, found, none).select(
        "doc_id", "hit.*", F.round(F.col("hit.score") / F.col("hit.item_words"), 6).alias("similarity")
    )
