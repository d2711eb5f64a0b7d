"""op3: near-duplicate classes of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize
from . import simhash
from .rows import table

NAME = "op3_simhash_near_dedup"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    prints = materialize(docs.select(docs.doc_id.alias("id"), simhash.fingerprints(docs.text).alias("fp")), "simhash-prints")
    named = simhash.classes(prints)
    return prints.join(named, "fp").select(
        prints.id.alias("doc_id"), simhash.hex16(prints.fp).alias("fingerprint"), "component_id"
    )
