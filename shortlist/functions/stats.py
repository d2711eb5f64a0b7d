"""Statistics as column expressions.

All of these run inside generated code on one row per group; the counts they
take come from ordinary aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEED_SD_POINTS = 0.75
DECAY_BEYOND_MEASURED = 0.7008 / 0.9113
LARGEST_EXP_ARGUMENT = 709.0


def _null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def safe_ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    fallback = _null() if otherwise is None else F.lit(float(otherwise))
    return F.when(den != 0, num / den).otherwise(fallback)


def paired_se(b_only: Column, a_only: Column, n: Column) -> Column:
    """sqrt(discordant) / n; a non-positive n is an error."""
    return F.when(n > 0, F.sqrt((b_only + a_only).cast("double")) / n).otherwise(
        F.raise_error(F.lit("paired standard error needs a positive n")).cast("double")
    )


def log_gamma(x: Column) -> Column:
    """Stirling series after moving the argument above eight."""
    x = x.cast("double")
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + float(i))
    y = x + 8.0
    inv = 1.0 / y
    series = inv * (
        1.0 / 12.0 - inv * inv * (1.0 / 360.0 - inv * inv * (1.0 / 1260.0 - inv * inv / 1680.0))
    )
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series
    # For large arguments the shift product would overflow; the series alone is exact there.
    z = x
    inv_z = 1.0 / z
    series_z = inv_z * (1.0 / 12.0 - inv_z * inv_z * (1.0 / 360.0 - inv_z * inv_z / 1260.0))
    direct = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2.0 * math.pi) + series_z
    return F.when(x < 1000.0, stirling - F.log(shift)).otherwise(direct)


def log_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def mcnemar_exact(b_only: Column, a_only: Column) -> Column:
    """Two-sided exact p-value of a split at least this lopsided.

    The binomial tail is summed from its largest term downwards.  Terms further
    than nine standard deviations below it are beneath double precision, so
    the sum has O(sqrt(n)) terms however many queries disagree.
    """
    n = b_only + a_only
    lo = F.least(b_only, a_only)
    reach = F.least(lo, F.ceil(9.0 * F.sqrt(n.cast("double"))) + 60).cast("int")
    top = log_choose(n, lo) - n * math.log(2.0)
    tail = F.aggregate(
        F.sequence(F.lit(0), reach),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (lo - j) / (n - lo + j + 1)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return (
        F.when(
            (b_only < 0) | (a_only < 0),
            F.raise_error(F.lit("discordant counts cannot be negative")).cast("double"),
        )
        .when(n == 0, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), 2.0 * F.exp(top) * tail))
    )


def binomial_se(p: Column, n: Column) -> Column:
    """sqrt(p(1-p)/n); NaN for n = 0."""
    inner = F.greatest(p * (1.0 - p), F.lit(0.0))
    return F.when(n != 0, F.sqrt(inner / n)).otherwise(F.lit(float("nan")))


def binomial_expected(n: Column, m: int, j: int, p: Column) -> Column:
    """Expected number out of n with exactly j of m successes."""
    return n * float(math.comb(m, j)) * F.pow(p, F.lit(j)) * F.pow(1.0 - p, F.lit(m - j))


def ols_columns(x: Column, y: Column, tolerance: float, min_points: int = 3) -> dict[str, Column]:
    """Slope, intercept and correlation aggregates; null without enough variance."""
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    defined = (F.regr_count(y, x) >= min_points) & (sxx >= tolerance) & (syy >= tolerance)
    # try_divide: a plain division by a zero variance is an error under ANSI rules.
    slope = F.try_divide(sxy, sxx)
    return {
        "slope": F.when(defined, slope),
        "intercept": F.when(defined, F.regr_avgy(y, x) - slope * F.regr_avgx(y, x)),
        "r": F.when(defined, F.try_divide(sxy, F.sqrt(sxx * syy))),
    }


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; null when either side does not vary."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def budget_for(slope: Column, intercept: Column, target: float) -> Column:
    """k at which the fitted deficit law reaches ``target``.

    Null when the deficit does not fall, infinity when it falls too slowly for a double.
    """
    log_k = (F.lit(math.log(1.0 - target)) - intercept) / slope
    return (
        F.when(slope >= -1e-9, _null())
        .when(log_k > LARGEST_EXP_ARGUMENT, F.lit(float("inf")))
        .otherwise(F.exp(log_k))
    )


def pair_exponent(s0: Column, r0: Column, s1: Column, r1: Column) -> Column:
    """Exponent of the deficit between two measured points."""
    usable = (s1 > s0) & (r0 > 0) & (r0 < 1) & (r1 > 0) & (r1 < 1)
    return F.when(usable, F.log((1.0 - r0) / (1.0 - r1)) / F.log(s1 / s0))


def break_even(
    f: Column, b: Column, c: Column, steps: float, k: float, sec_step: float, sec_slot: float
) -> Column:
    """Queries above which a cut by factor ``f`` is cheaper bought with steps."""
    train = sec_step * steps * (F.pow(f, -1.0 / c) - 1.0)
    per_query = sec_slot * k * (F.pow(f, -1.0 / b) - 1.0)
    usable = (f > 0) & (f < 1) & (b > 0) & (c > 0)
    return F.when(usable & (per_query > 0), train / per_query)


def deficit_exponent(lo: Column, hi: Column, doublings: float | Column) -> Column:
    """Exponent per doubling; a cell at the ceiling is an error."""
    return F.when(
        (lo >= 1.0) | (hi >= 1.0),
        F.raise_error(F.lit("a cell is at the ceiling; its deficit has no logarithm")).cast(
            "double"
        ),
    ).otherwise(-F.log2((1.0 - hi) / (1.0 - lo)) / doublings)


def poisson_recovery(rate: Column) -> Column:
    return 1.0 - F.exp(-rate)


def union_if_independent(rates: Column) -> Column:
    """1 - product of misses over an array of rates."""
    return 1.0 - F.aggregate(rates, F.lit(1.0), lambda acc, p: acc * (1.0 - p))


def schedule_horizon(n_train: Column, batch: Column, epochs: Column, max_steps: Column) -> Column:
    horizon = epochs * F.ceil(n_train / batch)
    return F.least(horizon, max_steps)


def verdict(measured: Column, lo: Column, hi: Column) -> Column:
    return (
        F.when(measured < lo, F.lit("MISS LOW"))
        .when(measured > hi, F.lit("MISS HIGH"))
        .otherwise(F.lit("HIT"))
    )


def miss_points(measured: Column, lo: Column, hi: Column) -> Column:
    return (
        F.when(measured < lo, (measured - lo) * 100.0)
        .when(measured > hi, (measured - hi) * 100.0)
        .otherwise(F.lit(0.0))
    )


def against_range(measured: Column, lo: float, hi: float) -> Column:
    return (
        F.when(measured < lo, F.format_string("below by %.3f", F.lit(lo) - measured))
        .when(measured > hi, F.format_string("above by %.3f", measured - F.lit(hi)))
        .otherwise(F.lit("inside"))
    )


def array_mean(values: Column) -> Column:
    """Mean of a short array (one entry per run)."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def array_sd(values: Column) -> Column:
    """Sample standard deviation of a short array; null for fewer than two values."""
    mean = array_mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))
