"""The stages of the corpus pipeline: functions (spark, docs, folder) that return a DataFrame.

All but the last return the columns of ``docs``, whatever other columns there are, and only
rows of it; null and empty texts are rejected by the first stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import decontaminate, linededup, neardup, packing, quality
from .rows import ROW, SPACE, field, packed, table, unpacked, whole_text


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that the base rules and the fences of their language and source let pass."""
    measured = materialize(quality.metrics(docs), "quality-metrics")
    limits = materialize(quality.fences(materialize(quality.sketches(measured), "quality-sketch")), "quality-fences")
    return unpacked(quality.verdicts(measured, limits).where("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows without the passages that earlier rows have; rows of nothing else go."""
    done = linededup.dedup(docs)
    text = F.col("text")
    cut = F.size("cuts") > 0
    left = done.where(~cut | text.rlike(f"[^{SPACE}]"))
    columns = []
    for c in docs.columns:
        own = field(c)
        if c == "text":
            own = text
        elif c == "n_chars":
            own = F.when(cut, F.length(text).cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return left.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest id (nulls last), then text hash."""
    rows = packed(docs).select(
        ROW, field("doc_id").alias("id"), F.xxhash64(field("text")).alias("th"), whole_text(field("text")).alias("t")
    )
    sketched = rows.select("id", "th", "t", neardup.sketches(F.col("t")).alias("s")).select("id", "th", "t", "s.*")
    prints = materialize(sketched, "near-prints")
    one = prints.groupBy("fp").agg(F.min("bands").alias("bands"), F.min("print").alias("print"))
    named = neardup.labels(materialize(one, "near-nodes"), prints.select("fp", "t"))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th")).alias("k")
    label = F.coalesce("label", "fp").alias("label")
    winners = prints.join(named, prints.fp == named.node, "left").select("id", "th", label).groupBy("label").agg(first)
    winners = materialize(winners.select(F.col("k.id").alias("wid"), F.col("k.th").alias("wth")), "simhash-winners")
    kept = rows.join(winners, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select(ROW, "id", "th")
    # rows equal in id and text are one class; where there are such, one of them stays
    twice = materialize(prints.groupBy("id", "th").count().where("count > 1").select("id", "th"), "simhash-twice")
    if not twice.take(1):
        return unpacked(kept, docs.columns)
    again = twice.toDF("did", "dth")
    same = F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth"))
    lone = kept.join(again, same, "left_anti")
    many = kept.join(again, same, "left_semi").dropDuplicates(["id", "th"])
    return unpacked(lone.unionByName(many), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark."""
    blocks = decontaminate.blocks(table(spark, folder, "benchmark"))
    hits = [F.size(decontaminate.hits(docs.text, docs, block)) for block in blocks]
    return docs.where(reduce(lambda a, b: a + b, hits) == 0) if hits else docs


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences; ``ids`` holds them as little-endian unsigned 32-bit numbers."""
    return packing.pack(docs, packing.public_vocabulary(packing.VOCABULARY))
