"""op10: adaptive quality verdicts over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize
from . import quality
from .rows import field, table

NAME = "op10_quality_rules"


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    measured = materialize(
        quality.metrics(docs).withColumn("doc_id", field("doc_id")).drop("__row"), "quality-metrics"
    )
    limits = quality.fences(materialize(quality.sketches(measured), "quality-sketch"))
    return quality.verdicts(measured, limits).select(
        "doc_id", *quality.BASE, "base_failed", "kept", "level", *[f"value.{m}" for m in quality.METRICS]
    )


def _bucket(v: str) -> str:
    return f"CASE WHEN {v} < 32 THEN {v} ELSE (length(bin({v})) - 5) * 32 + ({v} >> (length(bin({v})) - 6)) - 32 END"


_FLOOR = "CASE WHEN bucket < 32 THEN bucket ELSE (bucket % 32 + 32) << (bucket // 32 - 1) END"

_METRICS = {
    "symbols": "CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END",
    "dup_lines": "CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
    "upper": "CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END",
    "word_length": "CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END",
}


def _quantiles(keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    return f"""
      SELECT {by}, max(total) AS n,
             min(CASE WHEN 100 * seen >= 10 * total THEN {_FLOOR} END) AS q10,
             min(CASE WHEN 100 * seen >= 50 * total THEN {_FLOOR} END) AS q50
      FROM (SELECT {by}, bucket,
                   sum(sum(n)) OVER (PARTITION BY {by} ORDER BY bucket) AS seen,
                   sum(sum(n)) OVER (PARTITION BY {by}) AS total
            FROM sketch GROUP BY {by}, bucket)
      GROUP BY {by}"""


_SLACK = " ".join(f"WHEN '{m}' THEN {s}" for m, s in quality.SLACK.items())

SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
worded AS (
  SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM docs),
windows AS (
  SELECT r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM worded)),
repeated AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW}))) AS c FROM repeated GROUP BY r),
counted AS (
  SELECT doc_id, lang, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(c, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper
  FROM worded LEFT JOIN covered USING (r)),
measured AS (
  SELECT *, {", ".join(f"{x} AS {m}" for m, x in _METRICS.items())},
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counted),
sketch AS (
  SELECT lang, source, metric, {_bucket("v")} AS bucket, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, {", ".join(f"{m}::BIGINT AS {m}" for m in _METRICS)}
                 FROM measured WHERE NOT base_failed)
        ON {", ".join(_METRICS)} INTO NAME metric VALUE v)
  GROUP BY ALL),
own AS ({_quantiles("lang, source")}),
wide AS ({_quantiles("lang")}),
whole AS ({_quantiles("")}),
chosen AS (
  SELECT own.lang, own.source, own.metric,
         CASE WHEN own.n >= {quality.MIN_GROUP} THEN 0 WHEN wide.n >= {quality.MIN_GROUP} THEN 1 ELSE 2 END AS level,
         CASE level WHEN 0 THEN own.q10 WHEN 1 THEN wide.q10 ELSE whole.q10 END AS q10,
         CASE level WHEN 0 THEN own.q50 WHEN 1 THEN wide.q50 ELSE whole.q50 END AS q50
  FROM own JOIN wide USING (lang, metric) JOIN whole USING (metric)),
reach AS (
  SELECT *, {quality.SPREADS} * (q50 - q10) + CASE metric {_SLACK} END AS d FROM chosen),
fence AS (
  SELECT lang, source, max(level) AS level,
         {", ".join(f"max(CASE WHEN metric = '{m}' THEN q50 + d END) AS high_{m}" for m in _METRICS)},
         max(CASE WHEN metric = 'word_length' THEN q50 - d END) AS low_word_length
  FROM reach GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND {" AND ".join(f"{m} <= high_{m}" for m in _METRICS)}
                AND word_length >= low_word_length, false) AS kept,
       level::INT AS level, {", ".join(f"{m}::BIGINT AS {m}" for m in _METRICS)}
FROM measured LEFT JOIN fence USING (lang, source)
"""
