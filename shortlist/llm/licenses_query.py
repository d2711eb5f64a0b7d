"""op6: licences in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .rows import table

NAME = "op6_license_scans"


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "license", "template", "dice", F.col("first").cast("long").alias("first_line"), F.col("last").cast("long").alias("last_line")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({', '.join(map(_quoted, t))})" for t in licenses.templates())
_PAIRS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_WORDS = "list_filter(string_split_regex(lower({t}), '[^\\pL\\pN]+'), lambda x: x <> '')"
_T = licenses.LEAST_DICE

SQL = f"""
WITH template AS (
  SELECT key, license, {_PAIRS.format(w="w")} AS pairs
  FROM (SELECT key, license, {_WORDS.format(t="body")} AS w FROM (VALUES {_TEMPLATES}) AS v(key, license, body))),
cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         string_split(regexp_replace(text, '([.!?][\\x20\\x09]|\\n[\\x20\\x09]?)([^\\x20\\x09-\\x0D])', '\\1' || chr(1) || '\\2', 'g'),
                      chr(1)) AS lines
  FROM documents WHERE regexp_matches(text, '(?i)licen|reserved|permission|redistribut|software')),
line AS (
  SELECT r, i, {_PAIRS.format(w="w")} AS p
  FROM (SELECT r, i, {_WORDS.format(t="x")} AS w
        FROM (SELECT r, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM cut))),
part AS (
  SELECT r, i, key, first(n) AS n, count(*) AS k
  FROM (SELECT r, i, len(p) AS n, unnest(p) AS pair FROM line)
  JOIN (SELECT key, unnest(pairs) AS pair FROM template) USING (pair)
  GROUP BY r, i, key HAVING count(*) >= {licenses.LEAST_PART} * first(n)),
marked AS (
  SELECT *, coalesce(i - lag(i) OVER (PARTITION BY r, key ORDER BY i) > 2, true)::INT AS fresh FROM part),
run AS (
  SELECT r, key, g, min(i) AS a, max(i) AS b
  FROM (SELECT r, key, i, sum(fresh) OVER (PARTITION BY r, key ORDER BY i) AS g FROM marked) GROUP BY ALL),
body AS (
  SELECT r, doc_id, key, a, b, {_WORDS.format(t="array_to_string(lines[a + 1:b + 1], ' ')")} AS w FROM run JOIN cut USING (r)),
scored AS (
  SELECT r, doc_id, license, key, a, b,
         round(2 * len(list_intersect(p, pairs)) / (len(p) + len(pairs)), 6) AS dice
  FROM (SELECT *, {_PAIRS.format(w="w")} AS p FROM body) JOIN template USING (key)
  WHERE len(p) BETWEEN {_T} / (2 - {_T}) * len(pairs) AND (2 - {_T}) / {_T} * len(pairs))
SELECT doc_id, license, key AS template, dice, a AS first_line, b AS last_line
FROM scored WHERE dice >= {_T}
QUALIFY row_number() OVER (PARTITION BY r, a ORDER BY dice DESC, b - a DESC, key DESC) = 1
"""
