"""op5: main text of every row of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext
from .rows import table

NAME = "op5_html_extraction"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    out = pages.select("page_id", "url", htmltext.main_text(pages.html).alias("m"))
    return out.select(
        "page_id", "url", F.col("m.text").alias("text"), F.length("m.text").cast("long").alias("n_chars"), "m.n_lines"
    )
