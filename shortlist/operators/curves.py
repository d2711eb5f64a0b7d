"""Power-law fits of the deficit against budget and against steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

# Fixed values.
LADDER_TOLERANCE = 1e-9
TRACE_TOLERANCE = 1e-12


def _deficit_fit(x: Column, rec: Column, keep: Column, tolerance: float) -> dict[str, Column]:
    """Aggregates of the line through (log x, log(1 - rec)) over the rows kept."""
    lx = F.when(keep, F.log(x.cast("double")))
    ly = F.when(keep, F.log(1.0 - rec))
    return stats.ols_columns(lx, ly, tolerance)


def budget_fit(
    ladder: DataFrame,
    keys: Sequence[str] = ("run", "band"),
    *,
    min_k: int = 5,
    extrapolate_from: int = 20,
    targets: Sequence[float] = (0.9, 0.95, 0.99),
) -> DataFrame:
    """1 - rec(k) = A k^-b per group, an early refit scored at the top rung, and inverse budgets.

    An infinite budget is reported as null, with ``overflow_<target>`` telling it
    from a deficit that does not fall.
    """
    k, rec = F.col("k"), F.col("recovery")
    usable = (k >= min_k) & (rec < 1.0)
    full = _deficit_fit(k, rec, usable, LADDER_TOLERANCE)
    early = _deficit_fit(k, rec, usable & (k <= extrapolate_from), LADDER_TOLERANCE)
    fitted = ladder.groupBy(*keys).agg(
        F.max("n_queries").alias("n_queries"),
        F.max("k").alias("top_k"),
        F.max_by("recovery", "k").alias("recovery_at_top"),
        full["slope"].alias("__s"),
        full["intercept"].alias("__i"),
        full["r"].alias("correlation"),
        early["slope"].alias("__es"),
        early["intercept"].alias("__ei"),
    )
    checked = F.col("top_k") > extrapolate_from
    predicted = 1.0 - F.exp(F.col("__ei") + F.col("__es") * F.log(F.col("top_k")))
    out = (
        fitted.withColumn("exponent", -F.col("__s"))
        .withColumn("early_exponent", F.when(checked, -F.col("__es")))
        .withColumn("predicted_at_top", F.when(checked, predicted))
        .withColumn(
            "error_points", 100 * (F.col("recovery_at_top") - F.col("predicted_at_top"))
        )
    )
    for t in targets:
        need = stats.budget_for(F.col("__s"), F.col("__i"), t)
        name = f"{t:g}".replace(".", "_")
        inf = need == float("inf")
        out = out.withColumn(f"budget_for_{name}", F.when(~inf, need)).withColumn(
            f"overflow_{name}", F.coalesce(inf, F.lit(False))
        )
    return out.drop("__s", "__i", "__es", "__ei")


def usable_trace(
    trace: DataFrame, step: str = "step", recovery: str = "recovery", window=None
) -> DataFrame:
    """Points with a step and a finite log-deficit, inside an optional step window."""
    rows = trace.filter(
        F.col(step).isNotNull() & (F.col(recovery) > 0) & (F.col(recovery) < 1)
    )
    return rows.filter(F.col(step).between(*window)) if window else rows


def trace_fit(trace: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Exponent per run, refitted on the first part of the run and scored at its end."""
    ends = trace.groupBy("run").agg(
        F.max("step").alias("last_step"), F.max_by("recovery", "step").alias("rec_at_last")
    )
    rows = trace.join(ends, "run")
    step, rec = F.col("step"), F.col("recovery")
    full = _deficit_fit(step, rec, F.lit(True), TRACE_TOLERANCE)
    in_cut = step <= F.col("last_step") * fraction
    early = _deficit_fit(step, rec, in_cut, TRACE_TOLERANCE)
    fitted = rows.groupBy("run", "last_step", "rec_at_last").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("step").alias("first_step"),
        (-full["slope"]).alias("exponent"),
        full["r"].alias("correlation"),
        (-early["slope"]).alias("early_exponent"),
        early["intercept"].alias("__ei"),
    )
    predicted = 1.0 - F.exp(F.col("__ei")) * F.pow(F.col("last_step"), -F.col("early_exponent"))
    return (
        fitted.filter(F.col("exponent").isNotNull())
        .withColumn("predicted_at_last", predicted)
        .withColumn("error_points", 100 * (F.col("predicted_at_last") - F.col("rec_at_last")))
        .drop("__ei")
    )


def pair_exponents(
    short: DataFrame, long: DataFrame, short_steps: float, long_steps: float
) -> DataFrame:
    """Step exponent per (band, k) from two runs' ladders."""
    s = short.select("band", "k", F.col("recovery").alias("r0"))
    g = long.select("band", "k", "n_queries", F.col("recovery").alias("r1"))
    return s.join(g, ["band", "k"]).select(
        "band",
        "k",
        "n_queries",
        stats.pair_exponent(
            F.lit(float(short_steps)), F.col("r0"), F.lit(float(long_steps)), F.col("r1")
        ).alias("exponent"),
    )


def break_even_table(
    step_exponents: DataFrame,
    budget_exponents: DataFrame,
    cuts: Sequence[float],
    *,
    steps: float,
    k: int,
    sec_per_step: float,
    sec_per_slot: float,
) -> DataFrame:
    """Queries above which steps are the cheaper way to each cut, and the k it would take."""
    c, b = F.col("c"), F.col("b")
    joined = (
        step_exponents.filter(F.col("k") == k)
        .select("band", F.col("exponent").alias("c"))
        .join(budget_exponents.select("band", F.col("exponent").alias("b")), "band")
        .filter((c > 0) & (b > 0))
        .withColumn("cut", F.explode(F.array(*[F.lit(float(f)) for f in cuts])))
    )
    return joined.select(
        "band",
        "b",
        "c",
        (c / b).alias("ratio"),
        "cut",
        stats.break_even(F.col("cut"), b, c, steps, k, sec_per_step, sec_per_slot).alias(
            "queries"
        ),
        (k * F.pow(F.col("cut"), -1.0 / b)).alias("k_needed"),
    )
