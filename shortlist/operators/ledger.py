"""Ledgers and evaluation histories: leaderboards, matched steps, best and last records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .guards import require, run_protocols


def leaderboard(
    ledger: DataFrame,
    *,
    split: str | None = None,
    limit: int = 20,
    newest_first: bool = False,
) -> DataFrame:
    """Best (or newest) records; ``row`` is the position in append order.

    Zero sorts with the missing metrics, as -1.
    """
    rows = ledger.filter(F.col("split") == split) if split else ledger
    key = F.when(F.coalesce(F.col("primary_metric"), F.lit(0.0)) == 0.0, F.lit(-1.0)).otherwise(
        F.col("primary_metric")
    )
    if newest_first:
        return rows.orderBy(F.desc("row")).limit(limit)
    return rows.withColumn("__k", key).orderBy(F.desc("__k"), F.asc("row")).limit(limit).drop("__k")


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """Flatten the nested reports; absent cells are null."""
    at = lambda report, slice_, k: F.col(report)["slices"][slice_]["recovery_at_k"][k]
    model, base = at("model_report", "fp_unseen", "20"), at("baseline_report", "fp_unseen", "20")
    return (
        ledger.withColumn("rec_1", at("model_report", "all", "1"))
        .withColumn("rec_20", at("model_report", "all", "20"))
        .withColumn("unseen_20", model)
        .withColumn("base_20", base)
        .withColumn("delta", model - base)
        .withColumn("budget", F.coalesce(F.col("generation.budget"), F.lit("strings")))
    )


def last_records(trace: DataFrame, metric: str = "recovery") -> DataFrame:
    """Endpoint of every run."""
    return trace.groupBy("run").agg(
        F.max("step").alias("last_step"),
        F.max_by("epoch", "step").alias("epoch"),
        F.max_by(metric, "step").alias(metric),
    )


def best_records(trace: DataFrame, metric: str = "recovery") -> DataFrame:
    """Best evaluation of every run; a missing metric counts as 0, first wins."""
    w = Window.partitionBy("run").orderBy(
        F.desc(F.coalesce(F.col(metric), F.lit(0.0))), F.asc("step")
    )
    return (
        trace.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") == 1)
        .select("run", F.col("step").alias("best_step"), F.col(metric).alias("best"))
    )


def checkpoint_rule(
    trace: DataFrame, metric: str = "recovery", loss: str = "valid_loss", patience: int = 0
) -> DataFrame:
    """Which evaluations improved, how long since, and where patience ends the run.

    An evaluation improves on a larger metric, or on an equal one with lower
    loss.  A window holds one run's evaluations only.
    """
    run = Window.partitionBy("run").orderBy("step")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    # Larger metric first, then smaller loss: one struct that grows as the model improves.
    score = F.struct(F.col(metric).alias("m"), (-F.col(loss)).alias("l"))
    best_before = F.max(score).over(earlier)
    rows = (
        trace.withColumn("improved", best_before.isNull() | (score > best_before))
        .withColumn("__e", F.row_number().over(run))
        .withColumn(
            "__last",
            F.max(F.when(F.col("improved"), F.col("__e"))).over(
                run.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn("since_improved", F.col("__e") - F.col("__last"))
    )
    if not patience:
        return rows.withColumn("stopped", F.lit(False)).drop("__e", "__last")
    reached = F.min(F.when(F.col("since_improved") >= patience, F.col("__e"))).over(
        Window.partitionBy("run")
    )
    return (
        rows.withColumn("__stop", reached)
        .filter(F.col("__stop").isNull() | (F.col("__e") <= F.col("__stop")))
        .withColumn("stopped", F.coalesce(F.col("__e") == F.col("__stop"), F.lit(False)))
        .drop("__e", "__last", "__stop")
    )


def checkpoint_choice(trace: DataFrame, patience: int, **names) -> DataFrame:
    """Chosen evaluation and stop point of every run."""
    rows = checkpoint_rule(trace, patience=patience, **names)
    metric = names.get("metric", "recovery")
    return rows.groupBy("run").agg(
        F.max(F.when(F.col("improved"), F.col("step"))).alias("best_step"),
        F.max_by(metric, F.when(F.col("improved"), F.col("step"))).alias("best"),
        F.max("step").alias("last_step"),
        F.max("since_improved").alias("longest_wait"),
        F.max(F.col("stopped").cast("int")).alias("stopped"),
    )


def require_steps(trace: DataFrame) -> DataFrame:
    """The trace, or an error when a record has no step to place it by."""
    return trace.filter(
        require(
            F.col("step").isNotNull(),
            F.concat(F.col("run"), F.lit(": a record has no step")),
        )
    )


def equal_horizons(horizons: DataFrame) -> Column:
    """Scalar: do all runs with a known schedule decay to the same step?"""
    known = horizons.filter(F.col("horizon").isNotNull())
    return F.coalesce(
        known.agg((F.count_distinct("horizon") <= 1).alias("same")).scalar(), F.lit(True)
    )


def horizons(records: DataFrame) -> DataFrame:
    """``run, horizon`` from ``n_train, batch_size, epochs, max_steps``."""
    return records.select(
        "run",
        stats.schedule_horizon(
            F.col("n_train"), F.col("batch_size"), F.col("epochs"), F.col("max_steps")
        ).alias("horizon"),
    )


def matched_steps(
    trace: DataFrame,
    runs: Sequence[str],
    schedule: DataFrame | None = None,
    metric: str = "recovery",
) -> DataFrame:
    """``step`` and one column per run, for steps every run was evaluated at.

    No row comes back when the runs' schedules end at different steps: equal
    steps are then different points of their schedules.
    """
    rows = trace.filter(F.col("run").isin(*runs))
    cols = [F.max(F.when(F.col("run") == r, F.col(metric))).alias(r) for r in runs]
    out = (
        rows.groupBy("step")
        .agg(F.count_distinct("run").alias("__n"), *cols)
        .filter(F.col("__n") == len(runs))
        .drop("__n")
    )
    return out if schedule is None else out.filter(equal_horizons(schedule))


def comparable(trace: DataFrame) -> DataFrame:
    """``run, protocol, comparable`` over all runs."""
    seen = run_protocols(trace)
    same = seen.agg((F.count_distinct("protocol") <= 1).alias("same")).scalar()
    return seen.withColumn("comparable", same)
