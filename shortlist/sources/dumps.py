"""Nested per-query dumps, reports, ledgers and histories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..operators.guards import protocol
from ..operators.judge import QUERY
from ..session import is_complete

_BROKEN = "__broken"


def _stem() -> Column:
    """Name of the row's file without its last suffix: the run name."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"(?<=.)\.[^.]*$", "")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Dump files of a folder or glob, one row per query, with ``run`` from the file name.

    ``query_id`` is the position of the query text's digest, so that the same
    reference gets the same id in every run.
    """
    rows = (
        spark.read.schema(schemas.DUMP)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("run", _stem())
    )
    return rows.withColumn(
        "query_id", F.conv(F.substring(F.md5("reference"), 1, 15), 16, 10).cast("long")
    )


def dump_queries(dump: DataFrame, size: Column | None = None) -> DataFrame:
    return dump.select(
        "run",
        "query_id",
        "fp_unseen",
        "n_samples",
        (size if size is not None else F.lit(None)).cast("int").alias("size"),
        F.col("reference").alias("ref_canonical"),
    )


def dump_judged(dump: DataFrame, cand_size: Column | None = None) -> DataFrame:
    """One row per candidate in generation order; empty queries give one row with null ``pos``."""
    flat = dump.select("run", "query_id", F.posexplode_outer("results").alias("pos", "r"))
    size = cand_size if cand_size is not None else F.lit(None)
    return flat.select(
        "run", "query_id", F.col("pos").cast("long").alias("pos"), "r.*"
    ).withColumn("cand_size", size.cast("int"))


def write_dumps(queries: DataFrame, judged: DataFrame, path: str, mode: str = "errorifexists"):
    """Nested form again: one JSON row per query, one folder per run.

    An array holds the candidates of one query, which the format itself requires.
    """
    fields = [f.name for f in schemas.RESULT.fields]
    nested = (
        judged.filter(F.col("pos").isNotNull())
        .groupBy(*QUERY)
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))).alias("__r"))
    )
    rows = queries.join(nested, list(QUERY), "left").select(
        "run",
        F.col("ref_canonical").alias("reference"),
        "fp_unseen",
        "n_samples",
        F.coalesce(
            F.transform("__r", lambda s: s["r"]), F.array().cast(schemas.DUMP["results"].dataType)
        ).alias("results"),
    )
    rows.write.mode(mode).partitionBy("run").json(path)


def read_written_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Dumps written by :func:`write_dumps`; the run is the folder."""
    schema = StructType([*schemas.DUMP.fields, StructField("run", StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn(
            "query_id", F.conv(F.substring(F.md5("reference"), 1, 15), 16, 10).cast("long")
        )
    )


def _document(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_band_report(spark: SparkSession, path: str) -> DataFrame:
    """``k, order, metric, budget, band, n_queries, run, rate``."""
    doc = _document(spark, path, schemas.BAND_REPORT)
    bands = doc.select("k", "order", "metric", "budget", F.explode("bands").alias("band", "b"))
    return bands.select(
        "k", "order", "metric", "budget", "band", "b.n_queries",
        F.explode("b.per_run").alias("run", "rate"),
    )


def read_anatomy_report(spark: SparkSession, path: str, run: str) -> DataFrame:
    """``run, band, n_queries, k, recovery``: the ladder of one run."""
    doc = _document(spark, path, schemas.ANATOMY_REPORT)
    bands = doc.select(F.explode("bands").alias("band", "b"))
    return bands.select(
        F.lit(run).alias("run"), "band", "b.n_queries", F.explode("b.recovery_at_k").alias("__k", "recovery")
    ).select("run", "band", "n_queries", F.col("__k").cast("int").alias("k"), "recovery")


def read_mix_record(spark: SparkSession, path: str, arm: str) -> DataFrame:
    """``arm, band, ratio``: weighted over plain share of training."""
    doc = _document(spark, path, schemas.MIX_RECORD)
    bands = doc.select(F.explode("size_weighted_mix.bands").alias("band", "b"))
    return bands.select(
        F.lit(arm).alias("arm"), "band", F.try_divide("b.weighted_share", "b.share").alias("ratio")
    )


def read_registration(spark: SparkSession, path: str) -> DataFrame:
    doc = _document(spark, path, schemas.REGISTRATION)
    return doc.select("metric", "k", F.explode("rows").alias("r")).select("metric", "k", "r.*")


def read_histories(spark: SparkSession, path: str, slice_: str = "fp_unseen", k: str = "20"):
    """``run, epoch, step, train_loss, valid_loss, recovery, protocol``.

    ``run`` is the folder above each history file.  The slice falls back to
    ``all``; rows of the oldest schema have a null step, which callers must face.
    """
    doc = (
        spark.read.schema(schemas.TRACE_RECORD)
        .option("multiLine", True)
        .json(path)
        .withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )
    cell = F.coalesce(F.col("valid.slices")[slice_], F.col("valid.slices")["all"])
    return doc.select(
        "run",
        "epoch",
        "step",
        "train_loss",
        "valid_loss",
        cell["recovery_at_k"][k].alias("recovery"),
        F.col("valid.slices")["all"]["validity"].alias("validity"),
        protocol(
            F.col("valid.budget"), F.col("valid.ks"), cell["budget_filled_rate"].isNotNull()
        ).alias("protocol"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Records in any number of appended files; blank and broken lines are skipped, and only those."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    schema = StructType([*schemas.LEDGER.fields, StructField(_BROKEN, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    rows = lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")
    return rows.filter(F.col(_BROKEN).isNull()).drop(_BROKEN)


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    if not re.fullmatch(r"json|parquet", fmt):
        raise ValueError(f"report format must be json or parquet, got {fmt!r}")
    report.write.mode("overwrite").format(fmt).save(path)


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vocab.write.mode(mode).parquet(path)


def read_vocabulary(spark: SparkSession, path: str, specials: Sequence[str]) -> DataFrame:
    """The vocabulary, or an error when the special tokens do not lead it."""
    vocab = spark.read.parquet(path)
    head = F.array(*[F.lit(s) for s in specials])
    place = F.element_at(head, (F.col("id") + 1).cast("int"))
    ok = (F.col("id") >= len(specials)) | (place == F.col("token"))
    return vocab.filter(
        F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("vocabulary does not start with the special tokens")).cast("boolean")
        )
    )


def cached_mask(
    mask: DataFrame, path: str, config_id: str, split: str = "all", grouping: str = "none"
) -> DataFrame:
    """A seen/unseen mask stored per feature configuration, split and grouping.

    Written once for each of these, so no other mask is ever picked up.  A folder that was
    left half written is written again.
    """
    spark = mask.sparkSession
    folder = f"{path}/config_id={config_id}/split={split}/grouping={grouping}"
    if not is_complete(spark, folder):
        mask.write.mode("overwrite").parquet(folder)
    return spark.read.schema(mask.schema).parquet(folder)
