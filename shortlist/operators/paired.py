"""Band tables, paired tests and between-run variance.

Runs are few and named by the caller, so each query's outcomes become one short
array and every pair of runs is a pair of conditional counts in one aggregation:
no self-join over queries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.bands import DEFAULT_BANDS, Band, band_labels
from .guards import require
from .metrics import hits
from .quantiles import medians

TOTAL = "*"


def hit_matrix(
    summary: DataFrame,
    runs: Sequence[str],
    k: int,
    order: str = "generation",
    metric: str = "recovery",
    unseen_only: bool = True,
) -> DataFrame:
    """``query_id, size, hits array<boolean>`` in run order.

    A query that some run was not scored on is an error: a paired comparison
    over different queries means nothing.
    """
    rows = hits(summary, k, order, metric, unseen_only).filter(F.col("run").isin(*runs))
    cols = [F.max(F.when(F.col("run") == r, F.col("hit"))).alias(f"h{i}") for i, r in enumerate(runs)]
    wide = rows.groupBy("query_id").agg(F.max("size").alias("size"), *cols)
    aligned = F.lit(True)
    for i in range(len(runs)):
        aligned = aligned & F.col(f"h{i}").isNotNull()
    return wide.filter(require(aligned, "runs were scored on different queries")).select(
        "query_id", "size", F.array(*[F.col(f"h{i}") for i in range(len(runs))]).alias("hits")
    )


def _pairs(runs: Sequence[str], pairs: Sequence[tuple[str, str]] | None):
    wanted = list(pairs) if pairs else list(combinations(runs, 2))
    index = {r: i for i, r in enumerate(runs)}
    return [(a, b, index[a], index[b]) for a, b in wanted]


def discordance_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """(b_only, a_only) aggregates."""
    return F.count_if(b & ~a), F.count_if(a & ~b)


def band_counts(
    matrix: DataFrame,
    runs: Sequence[str],
    bands: str | Sequence[Band] = DEFAULT_BANDS,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per non-empty band with rates and discordant counts as arrays."""
    labelled = matrix.withColumn(
        "band",
        F.explode(F.concat(F.array(F.lit(TOTAL)), band_labels(F.col("size"), bands))),
    )
    h = [F.element_at("hits", i + 1) for i in range(len(runs))]
    rates = F.array(*[F.avg(c.cast("double")) for c in h])
    wanted = _pairs(runs, pairs)
    aggs = [F.count(F.lit(1)).alias("n_queries"), rates.alias("rates")]
    if wanted:
        disc = [discordance_counts(h[i], h[j]) for _, _, i, j in wanted]
        aggs += [
            F.array(*[b for b, _ in disc]).alias("b_only"),
            F.array(*[a for _, a in disc]).alias("a_only"),
        ]
    grouped = labelled.groupBy("band").agg(*aggs)
    # One row per band is left, so a window over all of them stays tiny.
    whole = Window.partitionBy(F.lit(1))
    return grouped.withColumn(
        "n_protocol", F.max(F.when(F.col("band") == TOTAL, F.col("n_queries"))).over(whole)
    ).filter(F.col("band") != TOTAL)


def band_rates(counts: DataFrame, runs: Sequence[str]) -> DataFrame:
    """``band, run, n_queries, share_of_protocol, rate``, with the spread for 3+ runs."""
    entries = F.array(
        *[
            F.struct(F.lit(r).alias("run"), F.element_at("rates", i + 1).alias("rate"))
            for i, r in enumerate(runs)
        ]
    )
    many = len(runs) >= 3
    return counts.select(
        "band",
        "n_queries",
        (F.col("n_queries") / F.col("n_protocol")).alias("share_of_protocol"),
        (100 * stats.array_sd(F.col("rates")) if many else F.lit(None).cast("double")).alias(
            "between_run_sd_points"
        ),
        (stats.array_mean(F.col("rates")) if many else F.lit(None).cast("double")).alias(
            "between_run_mean"
        ),
        F.explode(entries).alias("e"),
    ).select(
        "band",
        "e.run",
        "n_queries",
        "share_of_protocol",
        "e.rate",
        "between_run_mean",
        "between_run_sd_points",
    )


def band_pairs(
    counts: DataFrame, runs: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Gap, paired error and exact p-value per band and pair; the gap is b minus a."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.element_at("rates", i + 1).alias("rate_a"),
                F.element_at("rates", j + 1).alias("rate_b"),
                F.element_at("b_only", p + 1).alias("b_only"),
                F.element_at("a_only", p + 1).alias("a_only"),
            )
            for p, (a, b, i, j) in enumerate(_pairs(runs, pairs))
        ]
    )
    rows = counts.select("band", "n_queries", F.explode(entries).alias("e")).select(
        "band", "n_queries", "e.*"
    )
    return add_paired_statistics(rows)


def add_paired_statistics(rows: DataFrame) -> DataFrame:
    """Columns derived from ``rate_a, rate_b, b_only, a_only, n_queries``."""
    b, a, n = F.col("b_only"), F.col("a_only"), F.col("n_queries")
    return (
        rows.withColumn("gap_points", 100 * (F.col("rate_b") - F.col("rate_a")))
        .withColumn("paired_se_points", 100 * stats.paired_se(b, a, n))
        .withColumn(
            "gap_in_paired_se",
            stats.safe_ratio(F.col("gap_points"), F.col("paired_se_points"), 0.0),
        )
        .withColumn("mcnemar_p", stats.mcnemar_exact(b, a))
    )


def paired_tests(
    matrix: DataFrame, runs: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """All (or the named) pairs over the whole protocol, smallest gap first."""
    counts = band_counts(matrix, runs, "all", pairs)
    return (
        band_pairs(counts, runs, pairs)
        .withColumn(
            "gap_in_seed_sd",
            F.col("gap_points") / (stats.SEED_SD_POINTS * math.sqrt(2.0)),
        )
        .drop("band")
        .orderBy(F.abs("gap_points"), "a", "b")
    )


def seed_variance(matrix: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row: mean over runs, spread, and the errors it compares with."""
    m = len(runs)
    counts = band_counts(matrix, runs, "all")
    rates = F.col("rates")
    mean, sd = stats.array_mean(rates), stats.array_sd(rates)
    n = F.col("n_queries")
    disc = F.zip_with("b_only", "a_only", lambda x, y: (x + y).cast("double"))
    return counts.select(
        n.alias("n_queries"),
        mean.alias("mean"),
        (100 * sd).alias("sd_points"),
        (100 * (F.array_max(rates) - F.array_min(rates))).alias("range_points"),
        (100 * sd / math.sqrt(m)).alias("se_of_mean_points"),
        (100 * stats.binomial_se(mean, n)).alias("binomial_se_points"),
        stats.array_mean(F.transform(disc, lambda d: 100 * F.sqrt(d) / n)).alias(
            "mean_mcnemar_se_points"
        ),
    )


def seed_pairs(matrix: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Pairwise disagreement; ``difference_points`` keeps the older a-minus-b sign."""
    rows = band_pairs(band_counts(matrix, runs, "all"), runs)
    discordant = F.col("a_only") + F.col("b_only")
    return rows.select(
        "a",
        "b",
        (-F.col("gap_points")).alias("difference_points"),
        discordant.alias("discordant"),
        (discordant / F.col("n_queries")).alias("discordant_rate"),
        F.col("paired_se_points").alias("mcnemar_se_points"),
    )


def seed_agreement(matrix: DataFrame, runs: Sequence[str]) -> DataFrame:
    """How many queries exactly j runs solved, against independence, with median size."""
    m = len(runs)
    solved = F.aggregate(
        F.col("hits"), F.lit(0), lambda acc, h: acc + F.when(h, 1).otherwise(0)
    )
    rows = matrix.withColumn("solved", solved)
    per_j = [
        F.struct(
            F.lit(j).alias("solved_by"),
            F.count_if(F.col("solved") == j).alias("observed"),
        )
        for j in range(m + 1)
    ]
    mean = F.avg(F.col("solved").cast("double")) / m
    total = rows.agg(
        F.count(F.lit(1)).alias("n"), mean.alias("p"), F.array(*per_j).alias("by_j")
    )
    chances = F.array(*[stats.binomial_expected(F.col("n"), m, j, F.col("p")) for j in range(m + 1)])
    counted = total.select(
        F.explode(F.arrays_zip("by_j", chances.alias("expected"))).alias("e")
    ).select(
        F.col("e.by_j.solved_by").alias("solved_by"),
        F.col("e.by_j.observed").alias("observed"),
        F.col("e.expected").alias("expected_if_independent"),
    )
    sizes = medians(rows.select(F.col("solved").alias("solved_by"), "size"), ["solved_by"], "size")
    return counted.join(sizes.withColumnRenamed("median", "median_size"), "solved_by", "left")
