"""Registered intervals: predict before a run, score after it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def three_cells(
    matched: DataFrame, corpus_scaled: DataFrame, pass_scaled: DataFrame
) -> DataFrame:
    """``band, n, matched, base, passes`` for bands measured in all three cells.

    Each input holds ``band, n_queries, rate`` of one run.
    """
    return (
        matched.select("band", F.col("rate").alias("matched"))
        .join(
            corpus_scaled.select(
                "band", F.col("n_queries").alias("n"), F.col("rate").alias("base")
            ),
            "band",
        )
        .join(pass_scaled.select("band", F.col("rate").alias("passes")), "band")
    )


def register_intervals(
    cells: DataFrame,
    *,
    target_passes: float = 6.0,
    base_passes: float = 1.2087,
    scaled_passes: float = 3.0,
    corpus_doublings: float = 1.0629,
) -> DataFrame:
    """Two extrapolation bounds per band, widened by one binomial error each side.

    The lower bound lets the exponent decay over the part of the extrapolation
    that lies beyond the measured range.
    """
    measured_range = math.log2(scaled_passes / base_passes)
    target = math.log2(target_passes / base_passes)
    covered = min(measured_range, target)
    beyond = max(0.0, target - measured_range)
    deficit = 1.0 - F.col("base")
    g = F.col("g_exponent")
    effective = covered + beyond * stats.DECAY_BEYOND_MEASURED
    rows = (
        cells.withColumn(
            "f_exponent",
            stats.deficit_exponent(F.col("matched"), F.col("base"), corpus_doublings),
        )
        .withColumn(
            "g_exponent",
            stats.deficit_exponent(F.col("matched"), F.col("passes"), measured_range),
        )
        .withColumn("extrapolation_hi", 1.0 - deficit * F.pow(F.lit(2.0), -g * target))
        .withColumn("extrapolation_lo", 1.0 - deficit * F.pow(F.lit(2.0), -g * effective))
    )
    lo, hi, n = F.col("extrapolation_lo"), F.col("extrapolation_hi"), F.col("n")
    return (
        rows.withColumn("se_at_lo", stats.binomial_se(lo, n))
        .withColumn("se_at_hi", stats.binomial_se(hi, n))
        .withColumn("registered_lo", lo - F.col("se_at_lo"))
        .withColumn("registered_hi", hi + F.col("se_at_hi"))
    )


def score_registration(
    registered: DataFrame,
    measured: DataFrame,
    *,
    problems: DataFrame | None = None,
    scored_bands: Sequence[str] | None = None,
) -> DataFrame:
    """Verdict per registered band.

    ``registered`` holds ``band, n, registered_lo, registered_hi``; ``measured``
    holds ``band, n_queries, rate``.  A band not measured is ``absent``, a band
    outside ``scored_bands`` is ``context``, and any convention problem refuses
    the whole comparison.
    """
    rate, n = F.col("rate"), F.col("n_queries")
    lo, hi = F.col("registered_lo"), F.col("registered_hi")
    joined = registered.select("band", "registered_lo", "registered_hi").join(
        measured.select("band", "n_queries", "rate"), "band", "left"
    )
    branch = stats.verdict(rate, lo, hi)
    context = (
        F.lit(False) if scored_bands is None else ~F.col("band").isin(*scored_bands)
    )
    status = (
        F.when(rate.isNull(), F.lit("absent")).when(context, F.lit("context")).otherwise(branch)
    )
    if problems is not None:
        refused = problems.select("problems").scalar() != ""
        status = F.when(refused, F.lit("REFUSED")).otherwise(status)
    out = joined.withColumn("verdict", status)
    scored = F.col("verdict").isin("HIT", "MISS LOW", "MISS HIGH")
    return (
        out.withColumn("se_points", F.when(scored, 100 * stats.binomial_se(rate, n)))
        .withColumn("miss_points", F.when(scored, stats.miss_points(rate, lo, hi)))
    )


def score_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if(F.col("verdict") == "HIT").alias("hits"),
        F.count_if(F.col("verdict").isin("HIT", "MISS LOW", "MISS HIGH")).alias("scored"),
    )


def score_exponents(
    exponents: DataFrame,
    budget_exponents: DataFrame,
    rates: DataFrame,
    *,
    registered: dict[str, float],
    b_range: tuple[float, float],
    ratio_range: tuple[float, float],
) -> DataFrame:
    """Step exponent against its registered value, budget exponent against a range.

    ``exponents``: ``band, exponent``; ``budget_exponents``: ``band, b``;
    ``rates``: ``band, rate`` at the top budget.
    """
    target = F.create_map(*[c for b, v in registered.items() for c in (F.lit(b), F.lit(v))])
    rows = (
        exponents.select("band", F.col("exponent").alias("c"))
        .join(budget_exponents.select("band", "b"), "band")
        .join(rates.select("band", "rate"), "band")
        .withColumn("registered_c", F.element_at(target, F.col("band")))
        .withColumn("c_ratio", stats.safe_ratio(F.col("c"), F.col("registered_c")))
        .withColumn("b_over_rate", stats.safe_ratio(F.col("b"), F.col("rate")))
    )
    return rows.withColumn("b_verdict", stats.against_range(F.col("b"), *b_range)).withColumn(
        "ratio_verdict", stats.against_range(F.col("b_over_rate"), *ratio_range)
    )


def points_per_doubling(old: DataFrame, new: DataFrame, doublings: float) -> DataFrame:
    """Gain per corpus doubling with the binomial error of the new cell."""
    rate, base = F.col("rate"), F.col("old_rate")
    return (
        new.select("band", "n_queries", "rate")
        .join(old.select("band", F.col("rate").alias("old_rate")), "band")
        .select(
            "band",
            "n_queries",
            "old_rate",
            "rate",
            (100 * (rate - base)).alias("delta_points"),
            (100 * (rate - base) / doublings).alias("points_per_doubling"),
            (
                100
                * F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) / F.col("n_queries"))
            ).alias("se_points"),
        )
    )


def deficit_cut_prediction(cells: DataFrame) -> DataFrame:
    """Carry the deficit cut seen in one cell pair over to the third cell."""
    cut = F.when(
        F.col("matched") < 1, (F.col("passes") - F.col("matched")) / (1 - F.col("matched"))
    )
    return cells.withColumn("deficit_cut", cut).withColumn(
        "predicted", 1 - (1 - F.col("base")) * (1 - F.col("deficit_cut"))
    )


def exchange_rate(
    short: DataFrame, long: DataFrame, pass_doublings: float, corpus_gain: float
) -> DataFrame:
    """Points per doubling of passes, and its ratio to the corpus gain."""
    gain = (F.col("long") - F.col("short")) * 100.0 / pass_doublings
    return (
        short.select("band", F.col("rate").alias("short"))
        .join(long.select("band", F.col("rate").alias("long")), "band")
        .select(
            "band",
            "short",
            "long",
            gain.alias("points_per_pass_doubling"),
            (gain / corpus_gain).alias("passes_over_corpus"),
        )
    )


def score_exchange(
    rates: DataFrame, *, registered_gain: float, ratio_range: tuple[float, float]
) -> DataFrame:
    """Pass gain of :func:`exchange_rate` beside its registered value, its ratio against a range."""
    gain = F.col("points_per_pass_doubling")
    return (
        rates.withColumn("registered_gain", F.lit(float(registered_gain)))
        .withColumn("gain_minus_registered", gain - F.col("registered_gain"))
        .withColumn("gain_over_registered", stats.safe_ratio(gain, F.col("registered_gain")))
        .withColumn("exchange_verdict", stats.against_range(F.col("passes_over_corpus"), *ratio_range))
    )
