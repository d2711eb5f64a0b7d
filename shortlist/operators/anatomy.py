"""What misses look like: anatomy by band, ladders, validity, size bias, preimages, taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.bands import (
    DEFAULT_BANDS,
    SIZE_BIAS_BANDS,
    VALIDITY_BANDS,
    explode_bands,
    half_open_bin,
)
from .judge import QUERY, proposals
from .metrics import hit_at
from .quantiles import medians

# Fixed values.
RUNGS = (1, 2, 5, 10, 20, 30, 40, 60, 80, 100, 150, 200)
NEAR_MISS = 0.9
ANALOGUE = 0.7


def raw_slots(
    queries: DataFrame, judged: DataFrame, k: int, unseen_only: bool = True
) -> DataFrame:
    """Per-query view over the first k raw slots, invalid and repeated ones included.

    Ranks are 1-based here, and similarity counts valid candidates only.
    """
    inside = judged.filter(F.col("pos") < k)
    per_query = inside.groupBy(*QUERY).agg(
        F.count(F.lit(1)).alias("n_slots"),
        (F.min(F.when(F.col("fp_match"), F.col("pos"))) + 1).alias("fp_rank"),
        (F.min(F.when(F.col("exact_structure"), F.col("pos"))) + 1).alias("st_rank"),
        F.max(F.when(F.col("valid"), F.col("tanimoto"))).alias("best_tanimoto"),
    )
    base = queries.filter("fp_unseen") if unseen_only else queries
    return (
        base.select(*QUERY, "size")
        .join(per_query, list(QUERY), "left")
        .withColumn("n_slots", F.coalesce("n_slots", F.lit(0)))
        .withColumn("best_tanimoto", F.coalesce("best_tanimoto", F.lit(0.0)))
    )


def miss_anatomy(slots: DataFrame, k: int, bands: str = DEFAULT_BANDS) -> DataFrame:
    """Recovery, collisions among hits and closeness of misses per run and band."""
    hit, exact = F.col("fp_rank").isNotNull(), F.col("st_rank").isNotNull()
    best = F.col("best_tanimoto")
    return (
        explode_bands(slots, "size", bands)
        .groupBy("run", "band")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.avg(hit.cast("double")).alias("recovery"),
            F.avg(exact.cast("double")).alias("structure"),
            F.coalesce(
                F.avg(F.when(hit, (~exact).cast("double"))), F.lit(0.0)
            ).alias("collision_rate_among_hits"),
            F.avg(F.when(~hit, best)).alias("mean_best_tanimoto_among_misses"),
            F.coalesce(
                F.avg(F.when(~hit, (best >= NEAR_MISS).cast("double"))), F.lit(0.0)
            ).alias("fraction_of_misses_above_0_9"),
            F.avg((F.col("n_slots") >= k).cast("double")).alias("budget_filled_rate"),
            F.avg("fp_rank").alias("mean_fp_hit_rank"),
        )
    )


def recovery_ladder(
    slots: DataFrame, k: int, bands: str = DEFAULT_BANDS, rungs: Sequence[int] = RUNGS
) -> DataFrame:
    """``run, band, n_queries, k, recovery`` over the rungs that fit the budget."""
    ladder = [j for j in rungs if j <= k]
    cells = F.array(
        *[
            F.struct(
                F.lit(j).alias("k"),
                F.avg(F.coalesce(F.col("fp_rank") <= j, F.lit(False)).cast("double")).alias(
                    "recovery"
                ),
            )
            for j in ladder
        ]
    )
    return (
        explode_bands(slots, "size", bands)
        .groupBy("run", "band")
        .agg(F.count(F.lit(1)).alias("n_queries"), cells.alias("ladder"))
        .select("run", "band", "n_queries", F.explode("ladder").alias("c"))
        .select("run", "band", "n_queries", "c.k", "c.recovery")
    )


def ladder_gain(ladder: DataFrame, half: int = 10, full: int = 20) -> DataFrame:
    """Share of hits that needed the second half of the budget, and its gain in points."""
    at = lambda j: F.max(F.when(F.col("k") == j, F.col("recovery")))
    return (
        ladder.groupBy("run", "band")
        .agg(at(half).alias("at_half"), at(full).alias("at_full"))
        .filter(F.col("at_half").isNotNull() & F.col("at_full").isNotNull())
        .select(
            "run",
            "band",
            stats.safe_ratio(F.col("at_full") - F.col("at_half"), F.col("at_full")).alias(
                "last_half_share"
            ),
            (100 * (F.col("at_full") - F.col("at_half"))).alias("gain_points"),
        )
    )


def validity_by_band(summary: DataFrame, bands: str = VALIDITY_BANDS) -> DataFrame:
    """Ratios of sums per band; queries whose size is unknown are left out."""
    rows = summary.filter(F.col("fp_unseen") & F.col("size").isNotNull())
    cand, n = F.sum("n_candidates"), F.count(F.lit(1))
    return (
        explode_bands(rows, "size", bands)
        .groupBy("run", "band")
        .agg(
            n.alias("n_queries"),
            stats.safe_ratio(F.sum("n_valid"), cand).alias("validity"),
            (F.sum("n_valid") / n).alias("valid_per_query"),
            (cand / n).alias("proposals_per_query"),
            stats.safe_ratio(F.sum("n_duplicate"), cand).alias("duplicate_rate"),
        )
    )


def _sized_proposals(
    queries: DataFrame, judged: DataFrame, k: int, budget: str
) -> DataFrame:
    """First k proposals with a known size, beside their target's size.

    Queries without such a proposal drop out, unlike everywhere else.
    """
    w = Window.partitionBy(*QUERY).orderBy("first_pos")
    first_k = (
        proposals(judged, budget)
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= k)
        .filter(F.coalesce(F.col("cand_size"), F.lit(0)) > 0)
    )
    targets = queries.filter(F.col("fp_unseen") & F.col("size").isNotNull())
    return first_k.join(targets.select(*QUERY, "size"), list(QUERY))


def size_bias_queries(
    queries: DataFrame, judged: DataFrame, k: int = 20, budget: str = "molecules"
) -> DataFrame:
    """Per query: mean proposal size, the closest size, and how many are right-sized."""
    rows = _sized_proposals(queries, judged, k, budget)
    off = F.abs(F.col("cand_size") - F.col("size")).cast("long")
    nearness = F.struct(off.alias("off"), F.col("first_pos").alias("pos"))
    right = F.col("cand_size") == F.col("size")
    return rows.groupBy(*QUERY, "size").agg(
        (F.max("fp_match") == 1).alias("hit"),
        F.avg("cand_size").alias("mean_proposal"),
        F.count(F.lit(1)).alias("n_proposals"),
        F.min_by("cand_size", nearness).alias("closest"),
        F.count_if(right).alias("n_right"),
        F.count_if(right & (F.col("fp_match") == 1)).alias("n_right_matching"),
        F.count_if(F.col("fp_match") == 1).alias("n_matching"),
    )


def size_bias(per_query: DataFrame, bands: str = SIZE_BIAS_BANDS) -> DataFrame:
    """Bias of proposal sizes for misses and hits apart, per run and band."""
    hit, size = F.col("hit"), F.col("size")
    groups = []
    for name, mask in (("miss", ~hit), ("hit", hit)):
        groups += [
            F.count_if(mask).alias(f"n_{name}"),
            F.avg(F.when(mask, F.col("mean_proposal"))).alias(f"{name}_mean_proposal"),
            F.avg(F.when(mask, F.col("mean_proposal") - size)).alias(f"{name}_mean_bias"),
            F.avg(F.when(mask, F.col("closest") - size)).alias(f"{name}_closest_bias"),
        ]
    return (
        explode_bands(per_query, "size", bands)
        .groupBy("run", "band")
        .agg(F.count(F.lit(1)).alias("n_queries"), *groups)
    )


def right_size(per_query: DataFrame, bands: str = SIZE_BIAS_BANDS) -> DataFrame:
    """Right-sized proposals per query and how often one matches."""
    n = F.count(F.lit(1))
    return (
        explode_bands(per_query, "size", bands)
        .groupBy("run", "band")
        .agg(
            n.alias("n_queries"),
            (F.sum("n_proposals") / n).alias("valid_per_query"),
            (F.sum("n_right") / n).alias("right_size_per_query"),
            (F.sum("n_right") / F.sum("n_proposals")).alias("share_of_proposals"),
            (F.count_if(F.col("n_right") > 0) / n).alias("queries_with_any"),
            stats.safe_ratio(F.sum("n_right_matching"), F.sum("n_right")).alias(
                "match_rate_among_right_size"
            ),
        )
    )


def preimages(per_query: DataFrame, bands: str = SIZE_BIAS_BANDS) -> DataFrame:
    """Matching proposals per query against a Poisson spread of the same mean."""
    n, c = F.count(F.lit(1)), F.col("n_matching")
    rate = F.sum(c) / n
    share = lambda test: F.count_if(test) / n
    return (
        explode_bands(per_query, "size", bands)
        .groupBy("run", "band")
        .agg(
            n.alias("n_queries"),
            share(c > 0).alias("recovery"),
            rate.alias("preimages_per_query"),
            stats.poisson_recovery(rate).alias("poisson_recovery"),
            share(c == 0).alias("share_none"),
            share(c == 1).alias("share_one"),
            share(c == 2).alias("share_two"),
            share(c >= 3).alias("share_three_plus"),
            stats.safe_ratio(F.sum(c), F.count_if(c > 0)).alias("preimages_per_hit"),
        )
    )


def failure_bucket(
    too_long: Column, hit_anywhere: Column, twins: Column, best_tanimoto: Column
) -> Column:
    """First cause that applies to a missed query."""
    return (
        F.when(too_long, F.lit("too_long"))
        .when(hit_anywhere, F.lit("beyond_budget"))
        .when(twins > 0, F.lit("collision"))
        .when(best_tanimoto >= NEAR_MISS, F.lit("near"))
        .when(best_tanimoto >= ANALOGUE, F.lit("analogue"))
        .otherwise(F.lit("far"))
    )


def failure_taxonomy(failures: DataFrame) -> DataFrame:
    """``run, bucket, n, share`` of the missed queries."""
    counted = failures.groupBy("run", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most six rows per run.
    per_run = Window.partitionBy("run")
    return counted.withColumn("share", F.col("n") / F.sum("n").over(per_run))


def recovery_by_bins(rows: DataFrame, value: str, edges: Sequence[int]) -> DataFrame:
    """``run, bin, n, recovery`` over half-open bins; ``rows`` carries ``hit``."""
    return (
        rows.withColumn("bin", half_open_bin(F.col(value), edges))
        .filter(F.col("bin").isNotNull())
        .groupBy("run", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("recovery"))
    )


def success_vs_failure(rows: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Median of each attribute among hits and among misses."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes])
    long = rows.select("run", "hit", F.explode(cells).alias("c")).select("run", "hit", "c.*")
    found = medians(long, ["run", "attribute", "hit"], "v")
    names = F.array(*[F.lit(a) for a in attributes])
    every = rows.select("run").distinct().withColumn("attribute", F.explode(names))
    of = lambda hit: F.max(F.when(F.col("hit") == hit, F.col("median")))
    wide = found.groupBy("run", "attribute").agg(of(True).alias("hit_median"), of(False).alias("fail_median"))
    return every.join(wide, ["run", "attribute"], "left").select("run", "attribute", "hit_median", "fail_median")


def recovery_by_flag(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Recovery with and without each boolean attribute."""
    hit = F.col("hit").cast("double")
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("flag"),
                F.count_if(test).alias("n_with"),
                F.avg(F.when(test, hit)).alias("recovery_with"),
                F.avg(F.when(~test, hit)).alias("recovery_without"),
            )
            for name, test in flags.items()
        ]
    )
    return (
        rows.groupBy("run")
        .agg(cells.alias("cells"))
        .select("run", F.explode("cells").alias("c"))
        .select("run", "c.*")
    )


def rerank_orders(first_k: DataFrame, scores: dict[str, Column], ks: Sequence[int] = (1, 5)):
    """Hits under several orders of one fixed candidate list.

    ``first_k`` is cut at k slots, so each ordering sorts a short list.  Every
    score sorts downwards and ties keep the slot order.
    """
    orders = F.array(
        *[
            F.struct(F.lit(name).alias("order"), score.cast("double").alias("score"))
            for name, score in scores.items()
        ]
    )
    stacked = first_k.withColumn("__o", F.explode(orders)).select("*", "__o.*").drop("__o")
    w = Window.partitionBy(*QUERY, "order").orderBy(F.desc("score"), F.asc("slot"))
    ranked = stacked.withColumn("__rn", F.row_number().over(w))
    per_query = ranked.groupBy(*QUERY, "order").agg(
        *[
            F.max(((F.col("__rn") <= k) & (F.col(c) == 1)).cast("int")).alias(f"{n}_{k}")
            for k in ks
            for n, c in (("hit", "fp_match"), ("exact", "exact_structure"))
        ]
    )
    return per_query


def rerank_rates(
    queries: DataFrame, per_query: DataFrame, orders: Sequence[str], ks: Sequence[int] = (1, 5)
) -> DataFrame:
    """Rates over every unseen query; one without candidates counts as a miss."""
    names = F.array(*[F.lit(o) for o in orders])
    base = queries.filter("fp_unseen").select(*QUERY).withColumn("order", F.explode(names))
    columns = [f"{n}_{k}" for k in ks for n in ("hit", "exact")]
    return (
        base.join(per_query, [*QUERY, "order"], "left")
        .groupBy("run", "order")
        .agg(*[F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(c) for c in columns])
    )


def failure_report(summary: DataFrame, k: int) -> DataFrame:
    """Recovery inside the budget, over everything drawn, and of short lists."""
    hit = hit_at(k)
    anywhere = F.col("rank_gen_fp").isNotNull()
    short = F.col("n_scored") < k
    rows = summary.filter("fp_unseen")
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(hit.cast("double")).alias("recovery"),
        F.avg(anywhere.cast("double")).alias("recovery_any_drawn"),
        F.count_if(~hit).alias("n_fail"),
        F.count_if(short).alias("n_underfilled"),
        F.avg(F.when(short, hit.cast("double"))).alias("recovery_underfilled"),
        F.avg(F.when(~hit, F.col("best_tanimoto"))).alias("fail_best_tanimoto_mean"),
    )
