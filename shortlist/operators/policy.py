"""Routing policies, matched-cost comparisons, threshold sweeps and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.bands import explode_bands
from .judge import QUERY, SLOT, slot_keys
from .metrics import consensus_weight

# Fixed values.
POLICY_BITS = 62
CURVE_THRESHOLDS = tuple(range(30, 101, 2))
COST_CAPS = (20, 40, 60, 80, 100, 120)


def routed_policy(
    matrix: DataFrame, bits: str = "bits", threshold: int = POLICY_BITS, large: int = 35
) -> DataFrame:
    """Cold arm for feature-rich queries, hot arm for the rest; ``hits`` is (cold, hot)."""
    cold, hot = F.element_at("hits", 1), F.element_at("hits", 2)
    routed = F.col(bits) >= threshold
    chosen = F.when(routed, cold).otherwise(hot)
    big = F.col("size") >= large
    rate = lambda c: F.avg(c.cast("double"))
    agg = matrix.agg(
        F.count(F.lit(1)).alias("n_queries"),
        rate(cold).alias("cold"),
        rate(hot).alias("hot"),
        rate(chosen).alias("policy"),
        rate(cold | hot).alias("per_query_bound"),
        F.count_if(routed).alias("n_routed_cold"),
        (F.count_if(routed & big) / F.greatest(F.count_if(routed), F.lit(1))).alias(
            "routing_precision"
        ),
        (F.count_if(routed & big) / F.greatest(F.count_if(big), F.lit(1))).alias(
            "routing_recall"
        ),
        F.count_if(chosen & ~cold).alias("over_cold"),
        F.count_if(~chosen & cold).alias("under_cold"),
        F.count_if(chosen & ~hot).alias("over_hot"),
        F.count_if(~chosen & hot).alias("under_hot"),
    )
    n = F.col("n_queries")
    for arm in ("cold", "hot"):
        over, under = F.col(f"over_{arm}"), F.col(f"under_{arm}")
        agg = (
            agg.withColumn(f"gap_{arm}_points", 100 * (F.col("policy") - F.col(arm)))
            .withColumn(f"se_{arm}_points", 100 * stats.paired_se(over, under, n))
            .withColumn(f"p_{arm}", stats.mcnemar_exact(over, under))
        )
    return agg


def policy_curve(
    matrix: DataFrame, bits: str = "bits", thresholds: Sequence[int] = CURVE_THRESHOLDS
) -> DataFrame:
    """Recovery of the routed policy at each threshold.

    Queries are first counted by feature count and outcome, so the curve is read
    off that small table instead of repeating every query per threshold.
    """
    cold, hot = F.element_at("hits", 1), F.element_at("hits", 2)
    hist = matrix.groupBy(bits).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cold).alias("nc"),
        F.count_if(hot).alias("nh"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.coalesce(F.sum(F.when(F.col(bits) >= t, F.col("n"))), F.lit(0)).alias(
                    "routed_cold"
                ),
                (
                    F.sum(F.when(F.col(bits) >= t, F.col("nc")).otherwise(F.col("nh")))
                    / F.sum("n")
                ).alias("recovery"),
            )
            for t in thresholds
        ]
    )
    return hist.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def hits_at_cost(
    queries: DataFrame,
    judged: DataFrame,
    k: int,
    caps: Sequence[int | None],
    budget: str = "molecules",
) -> DataFrame:
    """``cap, run, query_id, hit`` when only the first ``cap`` raw candidates are seen.

    A cap of ``None`` sees everything and is reported as -1.  Votes under every
    cap come out of one aggregation; the caps multiply proposals, not candidates.
    """
    limits = [(-1, None) if c is None else (c, c) for c in caps]
    below = lambda c, limit: F.lit(True) if limit is None else F.col(c) < limit
    rows = judged.filter(F.col("pos").isNotNull())
    scored_rows = rows.filter("valid") if budget == "molecules" else rows
    votes = [
        F.count_if(below("pos", limit) & F.col("valid")).alias(f"v{i}")
        for i, (_, limit) in enumerate(limits)
    ]
    props = scored_rows.select("*", *slot_keys()).groupBy(*QUERY, *SLOT).agg(
        F.min("pos").alias("first_pos"),
        F.max(F.col("fp_match").cast("int")).alias("fp_match"),
        *votes,
    )
    per_cap = F.array(
        *[
            F.when(
                below("first_pos", limit),
                F.struct(F.lit(label).alias("cap"), F.col(f"v{i}").alias("votes")),
            )
            for i, (label, limit) in enumerate(limits)
        ]
    )
    w = Window.partitionBy("cap", *QUERY).orderBy(consensus_weight().desc())
    hit = (
        props.select(*QUERY, "first_pos", "fp_match", F.explode(F.array_compact(per_cap)).alias("c"))
        .select(*QUERY, "first_pos", "fp_match", "c.*")
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= k)
        .groupBy("cap", *QUERY)
        .agg((F.max("fp_match") == 1).alias("hit"))
    )
    base = (
        queries.filter("fp_unseen")
        .select(*QUERY)
        .withColumn("cap", F.explode(F.array(*[F.lit(label) for label, _ in limits])))
    )
    return base.join(hit, ["cap", *QUERY], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def matched_cost(cost_hits: DataFrame, cold: str, warm: str) -> DataFrame:
    """Paired comparison of two runs at each candidate cap; -1 is uncapped."""
    wide = cost_hits.groupBy("cap", "query_id").agg(
        F.max(F.when(F.col("run") == cold, F.col("hit"))).alias("c"),
        F.max(F.when(F.col("run") == warm, F.col("hit"))).alias("w"),
    )
    agg = wide.groupBy("cap").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("w").cast("double")).alias("warm"),
        F.avg(F.col("c").cast("double")).alias("cold"),
        F.count_if(F.col("c") & ~F.col("w")).alias("cold_only"),
        F.count_if(F.col("w") & ~F.col("c")).alias("warm_only"),
    )
    b, a, n = F.col("cold_only"), F.col("warm_only"), F.col("n_queries")
    return (
        agg.withColumn("gap_points", 100 * (F.col("cold") - F.col("warm")))
        .withColumn("paired_se_points", 100 * stats.paired_se(b, a, n))
        .withColumn("mcnemar_p", stats.mcnemar_exact(b, a))
    )


def mean_samples(queries: DataFrame) -> DataFrame:
    return queries.groupBy("run").agg(F.avg("n_samples").alias("samples_per_query"))


def feature_size_relation(rows: DataFrame, bits: str, size: str, bands: str) -> DataFrame:
    """Correlation of feature count and size, and the feature count per band."""
    r = rows.agg(stats.pearson(F.col(bits), F.col(size)).alias("r")).scalar()
    return (
        explode_bands(rows, size, bands)
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(bits).alias("mean_bits"),
            F.coalesce(F.stddev_samp(bits), F.lit(0.0)).alias("sd_bits"),
        )
        .withColumn("r", r)
    )


def threshold_sweep(rows: DataFrame, bits: str, positive: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of ``bits >= t`` at every integer cut.

    One histogram over ``bits`` carries all the counts: the rows of a cut are a
    reverse running sum over it.  Cuts between two present values repeat the next one's sums.
    """
    hist = rows.groupBy(F.col(bits).cast("long").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p")
    )
    # The histogram has one row per distinct feature count (at most the fold width).
    up = Window.partitionBy(F.lit(1)).orderBy(F.desc("b")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    whole = Window.partitionBy(F.lit(1))
    sums = hist.select(
        "b",
        F.sum("n").over(up).alias("at"),
        F.sum("p").over(up).alias("tp"),
        F.sum("n").over(whole).alias("total"),
        F.sum("p").over(whole).alias("pos"),
        F.coalesce(F.lag("b").over(Window.partitionBy(F.lit(1)).orderBy("b")) + 1, F.col("b")).alias(
            "from_cut"
        ),
    )
    cuts = sums.withColumn("cut", F.explode(F.sequence("from_cut", "b")))
    precision = stats.safe_ratio(F.col("tp"), F.col("at"), 0.0)
    recall = stats.safe_ratio(F.col("tp"), F.col("pos"), 0.0)
    return (
        cuts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            stats.safe_ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0
            ),
        )
        .withColumn(
            "accuracy",
            (F.col("total") - (F.col("at") - F.col("tp")) - (F.col("pos") - F.col("tp")))
            / F.col("total"),
        )
        .select("cut", "precision", "recall", "f1", "accuracy")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest F1; the lowest cut wins a tie."""
    return sweep.orderBy(F.desc("f1"), F.asc("cut")).limit(1)


def grid_best(metrics: DataFrame, order: Sequence[str], score: str, default: str) -> DataFrame:
    """Best grid cell by ``score``; the first one in ``order`` wins a tie."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("run"))
    base = metrics.filter(F.col("run") == default).select(score).scalar()
    return (
        metrics.filter(F.col("run").isin(*order))
        .orderBy(F.desc(score), place)
        .limit(1)
        .select(
            "run",
            F.col(score).alias("score"),
            (100 * (F.col(score) - base)).alias("best_vs_default_points"),
        )
    )

