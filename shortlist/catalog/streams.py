"""Streaming jobs run to the end over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import FeatureConfig, feature_set, set_key
from ..functions.hashing import hash_bucket
from ..sources import tables as t
from ..streaming import jobs
from . import sqlviews as v
from .ledgers import _LEDGER
from .registry import query


def _stream(spark, path, name):
    """The table as a file stream; the glob fits a single file and a folder alike."""
    static = t.table(spark, path, name)
    return spark.readStream.schema(static.schema).parquet(f"{path}/{name}.parquet*")


@query(
    "stream_ledger",
    f"""WITH {_LEDGER} SELECT run, count(*) AS n, max(primary_metric) AS best,
      max("row") AS last_row, arg_max(n_parameters, "row") AS last_parameters FROM ledger GROUP BY run""",
)
def stream_ledger(spark, path):
    events = _stream(spark, path, "events")
    records = events.select(
        F.col("event_id").alias("row"),
        (F.col("user_id") % 50).alias("run"),
        F.when(F.col("event_type") != "error", F.round(F.col("value") / 1000.0, 6)).alias(
            "primary_metric"
        ),
        F.get_json_object("props", "$.k").cast("long").alias("n_parameters"),
    )
    return jobs.run_ledger(records)


@query(
    "stream_sample",
    f"""SELECT event_id, user_id, (SELECT count(*) FROM events) AS stream_length FROM events
    ORDER BY {v.okey("'rs:' || event_id")}, event_id LIMIT 200""",
)
def stream_sample(spark, path):
    events = _stream(spark, path, "events").select("event_id", "user_id")
    return jobs.bounded_sample(events, 200, "rs", "event_id")


@query(
    "stream_unseen",
    f"""WITH {v.ITEMS}, f AS (SELECT item_id, md5(canonical) AS digest,
      {v.bits_key(v.feature_bits('tokens', 128))} AS key FROM items),
    k AS (SELECT DISTINCT key FROM f WHERE {v.hb("'st:' || item_id", 2)} = 0)
    SELECT digest, min(key NOT IN (SELECT key FROM k)) AS fp_unseen FROM f GROUP BY digest""",
)
def stream_unseen(spark, path):
    """Arriving documents: repeats dropped, keys checked against a training snapshot."""
    cfg = FeatureConfig(n_bits=128)

    def shaped(docs):
        return docs.select(
            F.col("doc_id").alias("item_id"),
            F.md5(t.canonical_text(F.col("text"))).alias("digest"),
            set_key(feature_set(t.word_tokens(F.col("text")), cfg)).alias("key"),
        )

    train = shaped(t.table(spark, path, "documents")).filter(
        hash_bucket(2, "st", F.col("item_id")) == 0
    )
    arrivals = shaped(_stream(spark, path, "documents")).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000))
    )
    flagged = jobs.arriving_items(arrivals, train).select("digest", "fp_unseen")
    return jobs.run_to_end(flagged, "unseen")


@query(
    "stream_judging",
    """WITH d AS (SELECT user_id AS query_id, event_id AS draw, floor(value)::BIGINT % 60 AS raw FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY draw) AS drawn FROM d),
    u AS (SELECT query_id, raw, min(draw) AS draw, min(drawn) AS drawn FROM f GROUP BY query_id, raw),
    c AS (SELECT *, CASE WHEN raw % 11 <> 0 THEN (raw % 20)::VARCHAR END AS canonical FROM u),
    m AS (SELECT *, canonical IS NOT NULL AND draw > min(draw)
      OVER (PARTITION BY query_id, canonical) AS duplicate FROM c),
    r AS (SELECT *, count(*) FILTER (canonical IS NOT NULL AND NOT duplicate)
      OVER (PARTITION BY query_id ORDER BY draw) AS n_filled FROM m)
    SELECT 'live' AS run, query_id, draw, raw::VARCHAR AS raw, canonical, duplicate,
      n_filled::INT AS n_filled, n_filled < 8 AND drawn < 30 AS wants_more FROM r""",
)
def stream_judging(spark, path):
    events = _stream(spark, path, "events")
    raw = F.floor("value") % 60
    draws = events.select(
        F.lit("live").alias("run"),
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("draw"),
        F.col("ts").cast("timestamp").alias("ts"),
        raw.cast("string").alias("raw"),
        F.when(raw % 11 != 0, (raw % 20).cast("string")).alias("canonical"),
    )
    return jobs.run_to_end(jobs.incremental_judging(draws, k=8, cap=30), "judging")
