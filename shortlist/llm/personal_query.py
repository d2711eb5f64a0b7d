"""op11: personal data in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import personal
from .rows import table
from .secrets_query import _listed

NAME = "op11_personal_data"
#: Places of matches, checksums over letters and words nearby are beyond a SQL twin.
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", personal.spans(docs.text).alias("s"))
    of = lambda kind: F.filter("s", lambda x: x["kind"] == kind)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal.BASE],
        F.sha2(_listed(F.filter("s", lambda x: x["kind"].isin(*personal.BASE))), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: ~x["kind"].isin(*personal.BASE))).cast("long").alias("n_added"),
        F.transform("s", lambda x: x["score"]).alias("scores"),
    )
