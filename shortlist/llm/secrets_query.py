"""op1: secrets in ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .packing import public_vocabulary
from .rows import table

NAME = "op1_secret_scans"
SQL = None


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", secrets.spans(docs.text, public_vocabulary(secrets.VOCABULARY)).alias("s"))
    of = lambda kind: F.filter("s", lambda x: x["kind"] == kind)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(F.filter("s", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        F.size(of("guess")).cast("long").alias("n_guess"),
        F.round(F.array_max(F.transform("s", lambda x: x["log10_guesses"])), 3).alias("most_log10_guesses"),
    )
