"""op12: hard negatives of every hundredth row of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import negatives
from .rows import table

NAME = "op12_hard_negatives"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.r AS a, b.vec_id AS id, a.vec_id AS anchor_id, a.label = b.label AS same,
         list_dot_product(a.x, b.x)::BIGINT AS score
  FROM parts a JOIN parts b ON a.r <> b.r WHERE a.vec_id % {negatives.ANCHOR_STEP} = 0),
positives AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS w
  FROM scored WHERE same QUALIFY w <= {negatives.POSITIVES})
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY a, w ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (a)
WHERE NOT same AND {negatives.LEAST_PERCENT} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {negatives.NEGATIVES}
"""
