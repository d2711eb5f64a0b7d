"""Scoring jobs: evaluation, band analysis, rerank, novelty."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.bands import DEFAULT_BANDS
from ..operators import metrics, paired
from ..operators.guards import same_queries
from ..operators.order import sample_exact, stratified_sample
from ..operators.prep import size_between
from ..operators.retrieve import clean_pool, seen_flag
from ..session import materialize
from ..sources import dumps


def evaluate_runs(
    queries: DataFrame,
    judged: DataFrame,
    ks: Sequence[int] = metrics.DEFAULT_KS,
    budget: str = "molecules",
    elapsed_seconds: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(report, headline)`` of every run."""
    summary = metrics.query_summary(queries, judged, budget)
    return metrics.recovery_report(summary, ks), metrics.run_headline(summary, ks, elapsed_seconds)


def evaluate_chain(
    queries: DataFrame,
    judged: DataFrame,
    folder: str,
    *,
    baseline: str,
    ks: Sequence[int] = metrics.DEFAULT_KS,
    budget: str = "molecules",
    split: str = "valid",
) -> DataFrame:
    """Scoring from dumps to ledger in one go; one row per run, as it was recorded.

    Candidates are counted by an observation while the dumps are written, not by a scan of their
    own; everything after reads the dumps back, so what is reported is what was stored.  The
    clock runs from the first read of a candidate to the last summary row.  ``folder`` then holds
    ``dumps``, ``report`` and ``ledger``.
    """
    spark = judged.sparkSession
    seen = Observation()
    started = time.monotonic()
    counted = judged.observe(seen, F.count(F.lit(1)).alias("candidates"), F.count_if("valid").alias("valid"))
    dumps.write_dumps(queries, counted, f"{folder}/dumps")
    stored = dumps.read_written_dumps(spark, f"{folder}/dumps")
    summary = materialize(
        metrics.query_summary(dumps.dump_queries(stored), dumps.dump_judged(stored), budget), "evaluated"
    )
    elapsed = time.monotonic() - started
    report = metrics.recovery_report(summary, ks)
    dumps.write_report(report, f"{folder}/report")
    headline = metrics.run_headline(summary, ks, elapsed)
    record = headline.select(
        F.col("run").alias("note"),
        F.lit(split).alias("split"),
        "primary_metric",
        F.struct(F.lit(max(ks)).alias("k"), F.col("budget").alias("budget")).alias("generation"),
    )
    dumps.append_ledger(record, f"{folder}/ledger")
    recorded = dumps.read_ledger(spark, f"{folder}/ledger").select(
        F.col("note").alias("run"), F.col("primary_metric").alias("recorded_metric")
    )
    return (
        headline.join(metrics.baseline_delta(headline, baseline).select("run", "delta"), "run", "left")
        .join(recorded, "run")
        .withColumn("observed_candidates", F.lit(seen.get["candidates"]))
        .withColumn("observed_valid", F.lit(seen.get["valid"]))
    )


def group_novelty_probe(
    summary: DataFrame, flags: DataFrame, per_group: int, seed: str, ks: Sequence[int]
) -> DataFrame:
    """Metrics of queries whose group training knows and of the others, from equal draws.

    ``flags`` holds ``query_id, group_seen``; up to ``per_group`` queries of each kind are drawn by
    a seeded order, the same for every run.  Only queries with unseen features count, so that the
    two slices differ in their groups and in nothing else.
    """
    drawn = stratified_sample(flags, "group_seen", per_group, seed, "query_id").select("query_id", "group_seen")
    rate = lambda hit: F.avg(hit.cast("double"))
    return (
        summary.join(drawn, "query_id")
        .groupBy("run", "group_seen")
        .agg(
            F.count(F.lit(1)).alias("n_sampled"),
            F.count_if("fp_unseen").alias("n_fp_unseen"),
            *[rate(F.when(F.col("fp_unseen"), metrics.hit_at(k))).alias(f"recovery_at_{k}") for k in ks],
            rate(F.when(F.col("fp_unseen"), metrics.hit_at(max(ks), metric="structure"))).alias("structure_accuracy"),
            F.avg(F.when(F.col("fp_unseen"), F.col("best_tanimoto"))).alias("mean_best_tanimoto"),
        )
    )


def common_protocol(
    pool: DataFrame,
    trains: DataFrame,
    n: int,
    seed: str,
    *,
    on: str = "digest",
    key: str = "key",
    size: str = "size",
    min_size: int | None = None,
    max_size: int | None = None,
) -> DataFrame:
    """Evaluation queries: in nobody's training set, size-bounded, a seeded draw, flagged unseen."""
    clean = clean_pool(pool, trains, on)
    bounded = size_between(clean, size, min_size, max_size)
    return seen_flag(sample_exact(bounded, n, seed, "item_id"), trains, key)


def tuning_draw(pool: DataFrame, protocol: DataFrame, n: int, seed: str) -> DataFrame:
    """A draw disjoint from the protocol's queries."""
    rest = pool.join(protocol.select("item_id"), "item_id", "left_anti")
    return sample_exact(rest, n, seed, "item_id")


def band_analysis(
    summary: DataFrame,
    runs: Sequence[str],
    bands: str = DEFAULT_BANDS,
    *,
    k: int = 20,
    order: str = "generation",
    metric: str = "recovery",
    pairs: Sequence[tuple[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(rates, pairs)`` per band."""
    matrix = paired.hit_matrix(summary, runs, k, order, metric)
    counts = paired.band_counts(matrix, runs, bands, pairs)
    return paired.band_rates(counts, runs), paired.band_pairs(counts, runs, pairs)


def checked_band_analysis(queries: DataFrame, judged: DataFrame, runs, bands, **convention):
    """The same from stored dumps, refusing runs scored on different queries."""
    summary = metrics.query_summary(same_queries(queries), judged)
    return band_analysis(summary, runs, bands, **convention)


def rerank(summary: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Both orders side by side for every run, unseen queries only."""
    wide = metrics.slice_metrics(summary, ks).filter(F.col("slice") == "fp_unseen")
    cells = [
        F.col(f"{column}_at_{k}{suffix}").alias(f"{name}_{k}")
        for name, column, suffix in (
            ("generation", "recovery", ""),
            ("consensus", "recovery", "_consensus"),
            ("structure_generation", "structure_accuracy", ""),
            ("structure_consensus", "structure_accuracy", "_consensus"),
        )
        for k in sorted(ks)
    ]
    return wide.select(
        "run",
        F.col("n_queries").alias("n_fp_unseen"),
        *cells,
        "duplicate_rate",
        "unique_valid_per_query",
    )


def novelty_penalty(flagged: DataFrame, k: int) -> DataFrame:
    """Recovery over groups training has seen minus recovery over new groups."""
    hit = metrics.hit_at(k).cast("double")
    seen = F.col("group_seen")
    return (
        flagged.filter("fp_unseen")
        .groupBy("run")
        .agg(
            F.count_if(seen).alias("n_seen"),
            F.count_if(~seen).alias("n_novel"),
            F.avg(F.when(seen, hit)).alias("recovery_seen"),
            F.avg(F.when(~seen, hit)).alias("recovery_novel"),
        )
        .withColumn("novelty_penalty", F.col("recovery_seen") - F.col("recovery_novel"))
    )
