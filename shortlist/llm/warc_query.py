"""op8: ``pages`` written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .files import new_folder
from .rows import table, whole_text

NAME = "op8_warc"


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    rows = pages.select("page_id", "url", F.encode(whole_text(pages.html), "utf-8").alias("payload"))
    archives = new_folder(spark, "warc")
    manifest = warc.write(rows, archives)
    return warc.read(manifest, archives, payloads=False).drop("payload", "url")


_LETTER = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {shift}) & 31)::INT, 1)" for shift in (15, 10, 5, 0)
)

SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex
  FROM pages),
grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS holder FROM p),
quads AS (
  SELECT r, string_agg({_LETTER}, '' ORDER BY k) AS digest
  FROM (SELECT r, k, ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT AS v FROM p, range(8) AS t(k))
  GROUP BY r)
SELECT page_id, octet_length(body) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM grouped JOIN quads USING (r)
"""
