"""Comparisons that must be refused, as checks inside the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(ok: Column, message: str | Column) -> Column:
    """True, or an error when the condition does not hold."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def run_signatures(queries: DataFrame, unseen_only: bool = True) -> DataFrame:
    """Order-free signature of each run's query set: how many, and their hash mix."""
    rows = queries.filter("fp_unseen") if unseen_only else queries
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("query_id")).alias("mix")
    )


def same_queries(queries: DataFrame, unseen_only: bool = True) -> DataFrame:
    """The queries table, or an error when runs were scored on different queries."""
    verdict = run_signatures(queries, unseen_only).agg(
        ((F.min("n") == F.max("n")) & (F.min("mix") == F.max("mix"))).alias("ok")
    )
    return queries.filter(
        require(
            F.coalesce(verdict.scalar(), F.lit(True)), "runs were scored on different queries"
        )
    )


def same_config(df: DataFrame, column: str, expected: str) -> DataFrame:
    """Rows stamped with the expected configuration id; any other stamp is an error."""
    return df.filter(
        require(
            F.col(column) == expected,
            F.concat(
                F.lit(f"expected feature config {expected}, found "),
                F.coalesce(F.col(column), F.lit("none")),
            ),
        )
    )


def protocol(budget: Column, ks: Column, tops_up: Column) -> Column:
    """How an evaluation was scored; numbers compare only when this is equal."""
    return F.struct(
        F.coalesce(budget, F.lit("legacy-string-budget")).alias("budget"),
        F.coalesce(ks, F.array().cast("array<int>")).alias("ks"),
        tops_up.alias("tops_up"),
    )


def run_protocols(trace: DataFrame, column: str = "protocol") -> DataFrame:
    """``run, protocol``; a protocol that changes within a run is an error."""
    return (
        trace.groupBy("run")
        .agg(F.collect_set(column).alias("seen"))
        .filter(
            require(
                F.size("seen") <= 1,
                F.concat(F.col("run"), F.lit(": evaluation protocol changed within the run")),
            )
        )
        .select("run", F.element_at("seen", 1).alias(column))
    )


def same_protocol(trace: DataFrame, column: str = "protocol") -> DataFrame:
    """The trace, or an error when its runs were scored in different ways."""
    distinct = run_protocols(trace, column).agg(F.count_distinct(column).alias("n"))
    return trace.filter(
        require(
            F.coalesce(distinct.scalar() <= 1, F.lit(True)),
            "runs were not scored the same way; score them under one protocol first",
        )
    )


def convention_problems(
    left: DataFrame, right: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """One row of differing convention columns between two one-row tables."""
    pairs = [
        F.when(
            ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")),
            F.concat(
                F.lit(f"{c} "),
                F.coalesce(F.col(f"l.{c}").cast("string"), F.lit("none")),
                F.lit(" vs "),
                F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("none")),
            ),
        )
        for c in columns
    ]
    one = F.lit(1)
    joined = (
        left.withColumn("__one", one)
        .alias("l")
        .join(right.withColumn("__one", one).alias("r"), F.col("l.__one") == F.col("r.__one"))
    )
    return joined.select(F.array_join(F.array_compact(F.array(*pairs)), "; ").alias("problems"))
