"""Per-query summaries and the recovery report.

A query is reduced once to the rank of its first hit under each order and
metric; recovery at any k, slice or band is then an average over queries.
Candidates are never multiplied by k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .judge import BUDGETS, ORDERS, QUERY, SLOT, slot_keys

SLICES = ("all", "fp_unseen")
METRICS = {"recovery": "fp", "structure": "ex"}
DEFAULT_KS = (1, 5, 20, 100)


def hit_rank_column(order: str, metric: str) -> str:
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; expected one of {ORDERS}")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {tuple(METRICS)}")
    return f"rank_{order[:3]}_{METRICS[metric]}"


def consensus_weight() -> Column:
    """More votes first, then the earlier position, as a pair that grows with rank."""
    return F.struct(F.col("votes").alias("votes"), (-F.col("first_pos")).alias("early"))


def item_table(judged: DataFrame, budget: str = "molecules") -> DataFrame:
    """One row per distinct item a query proposed, with the counts totals need.

    Everything later reads this table.  Repeats combine inside each input task,
    and invalid rows collapse to one row (``molecules``) or stay apart
    (``strings``, where each takes a slot).
    """
    if budget not in BUDGETS:
        raise ValueError(f"unknown budget {budget!r}; expected one of {BUDGETS}")
    item, alone = slot_keys()
    if budget == "molecules":
        alone = F.lit(None).cast("long").alias(SLOT[1])
    keyed = judged.filter(F.col("pos").isNotNull()).select("*", item, alone)
    votes = F.count_if(F.col("valid") & F.col("canonical").isNotNull())
    return keyed.groupBy(*QUERY, *SLOT).agg(
        F.min("pos").alias("first_pos"),
        votes.alias("votes"),
        F.max(F.col("fp_match").cast("int")).alias("fp"),
        F.max(F.col("exact_structure").cast("int")).alias("ex"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("valid").alias("n_valid"),
        F.count_if("duplicate").alias("n_duplicate"),
        F.max("tanimoto").alias("tanimoto"),
    )


def query_summary(
    queries: DataFrame, judged: DataFrame, budget: str = "molecules"
) -> DataFrame:
    """One row per query, the ones without candidates included.

    ``rank_<order>_<metric>`` is the 0-based slot of the first hit.  A rank is
    the number of items ahead of the hit, so it takes two aggregations and a
    join but no sort of a query's candidates in one task.
    """
    items = item_table(judged, budget)
    slot = F.col(SLOT[0]).isNotNull() | F.col(SLOT[1]).isNotNull()
    fp, ex = slot & (F.col("fp") == 1), slot & (F.col("ex") == 1)
    weight = consensus_weight()
    firsts = items.groupBy(*QUERY).agg(
        F.min(F.when(fp, F.col("first_pos"))).alias("__g_fp"),
        F.min(F.when(ex, F.col("first_pos"))).alias("__g_ex"),
        F.max(F.when(fp, weight)).alias("__c_fp"),
        F.max(F.when(ex, weight)).alias("__c_ex"),
        F.count_if(slot).alias("n_scored"),
        F.count_if(slot & (F.col("n_valid") > 0)).alias("n_unique"),
        F.sum("n").alias("n_candidates"),
        F.sum("n_valid").alias("n_valid"),
        F.sum("n_duplicate").alias("n_duplicate"),
        F.max("tanimoto").alias("best_tanimoto"),
    )
    targets = ("__g_fp", "__g_ex", "__c_fp", "__c_ex")
    hit = firsts.filter(F.col("__g_fp").isNotNull() | F.col("__g_ex").isNotNull())
    place = {"__g": F.col("first_pos"), "__c": F.col("__w")}

    def ahead(target: str) -> Column:
        mine = place[target[:3]]
        before = mine < F.col(target) if target.startswith("__g") else mine > F.col(target)
        return F.count_if(F.coalesce(before, F.lit(False)))

    names = ("rank_gen_fp", "rank_gen_ex", "rank_con_fp", "rank_con_ex")
    ranks = (
        items.filter(slot)
        .select(*QUERY, "first_pos", weight.alias("__w"))
        .join(hit.select(*QUERY, *targets), list(QUERY))
        .groupBy(*QUERY)
        .agg(
            *[
                F.when(F.max(F.col(c)).isNotNull(), ahead(c)).alias(name)
                for name, c in zip(names, targets)
            ]
        )
    )
    out = queries.join(firsts.drop(*targets), list(QUERY), "left").join(
        ranks, list(QUERY), "left"
    )
    zero = F.lit(0).cast("long")
    for c in ("n_candidates", "n_valid", "n_duplicate", "n_scored", "n_unique"):
        out = out.withColumn(c, F.coalesce(F.col(c), zero))
    return out.withColumn(
        "best_tanimoto", F.coalesce("best_tanimoto", F.lit(0.0))
    ).withColumn("budget", F.lit(budget))


def hit_at(k: int, order: str = "generation", metric: str = "recovery") -> Column:
    rank = F.col(hit_rank_column(order, metric))
    return F.coalesce(rank < k, F.lit(False))


def hits(
    summary: DataFrame,
    k: int,
    order: str = "generation",
    metric: str = "recovery",
    unseen_only: bool = True,
) -> DataFrame:
    """``run, query_id, size, hit`` for the queries of one convention."""
    rows = summary.filter("fp_unseen") if unseen_only else summary
    return rows.select("run", "query_id", "size", hit_at(k, order, metric).alias("hit"))


def explode_slices(summary: DataFrame, slices: Sequence[str] = SLICES) -> DataFrame:
    """One row per query and slice with ``inside``; empty slices keep their run."""
    unknown = sorted(set(slices) - set(SLICES))
    if unknown:
        raise ValueError(f"unknown slices {unknown}; expected a subset of {SLICES}")
    tests = {"all": F.lit(True), "fp_unseen": F.col("fp_unseen")}
    members = F.array(
        *[F.struct(F.lit(s).alias("slice"), tests[s].alias("inside")) for s in slices]
    )
    return summary.withColumn("__s", F.explode(members)).select("*", "__s.*").drop("__s")


def slice_metrics(summary: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Wide metrics per (run, slice); all null but ``n_queries`` when a slice is empty."""
    ks = sorted(set(int(k) for k in ks))
    inside = F.col("inside")

    def mean(value: Column) -> Column:
        return F.avg(F.when(inside, value.cast("double")))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(inside, value)), F.lit(0))

    n_cand = total(F.col("n_candidates"))
    nonempty = F.count_if(inside) > 0
    aggs = [F.count_if(inside).alias("n_queries")]
    for order in ORDERS:
        suffix = "" if order == "generation" else "_consensus"
        for metric, name in (("recovery", "recovery"), ("structure", "structure_accuracy")):
            aggs += [
                mean(hit_at(k, order, metric)).alias(f"{name}_at_{k}{suffix}") for k in ks
            ]
    share = lambda num: F.when(
        nonempty, F.when(n_cand > 0, total(num) / n_cand).otherwise(F.lit(0.0))
    )
    n_samples = total(F.col("n_samples"))
    aggs += [
        share(F.col("n_valid")).alias("validity"),
        share(F.col("n_duplicate")).alias("duplicate_rate"),
        mean(F.col("n_unique")).alias("unique_valid_per_query"),
        F.when(nonempty & (n_samples > 0), n_samples / F.count_if(inside)).alias(
            "mean_samples_per_query"
        ),
        mean(F.col("n_candidates")).alias("mean_candidates_per_query"),
        mean(F.col("n_scored")).alias("mean_scored_per_query"),
        mean(F.col("n_scored") >= max(ks)).alias("budget_filled_rate"),
        mean(F.col("best_tanimoto")).alias("mean_best_tanimoto"),
        mean(F.col("rank_gen_fp")).alias("mean_hit_rank"),
    ]
    return explode_slices(summary).groupBy("run", "slice").agg(*aggs)


def recovery_report(summary: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Long report ``run, slice, metric, k, value``; empty slices hold ``n_queries`` only."""
    ks = sorted(set(int(k) for k in ks))
    wide = slice_metrics(summary, ks)
    cells = [("n_queries", None, "n_queries")]
    for suffix in ("", "_consensus"):
        for name in ("recovery", "structure_accuracy"):
            cells += [(f"{name}_at_k{suffix}", k, f"{name}_at_{k}{suffix}") for k in ks]
    cells += [
        (c, None, c)
        for c in (
            "validity",
            "duplicate_rate",
            "unique_valid_per_query",
            "mean_samples_per_query",
            "mean_candidates_per_query",
            "mean_scored_per_query",
            "budget_filled_rate",
            "mean_best_tanimoto",
            "mean_hit_rank",
        )
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(k).cast("int").alias("k"),
                F.col(column).cast("double").alias("value"),
            )
            for metric, k, column in cells
        ]
    )
    return (
        wide.select("run", "slice", "n_queries", F.explode(entries).alias("e"))
        .filter((F.col("n_queries") > 0) | (F.col("e.metric") == "n_queries"))
        .select("run", "slice", "e.metric", "e.k", "e.value")
    )


def run_headline(
    summary: DataFrame, ks: Sequence[int] = DEFAULT_KS, elapsed_seconds: float | None = None
) -> DataFrame:
    """Primary metric, unseen share, budget label and throughput per run."""
    top = max(ks)
    unseen = F.col("fp_unseen")
    out = summary.groupBy("run").agg(
        F.coalesce(
            F.avg(F.when(unseen, hit_at(top).cast("double"))), F.lit(0.0)
        ).alias("primary_metric"),
        F.lit(f"recovery@{top} (fp_unseen)").alias("primary_metric_name"),
        (F.count_if(unseen) / F.count(F.lit(1))).alias("fp_unseen_fraction"),
        F.when(F.count_distinct("budget") == 1, F.min("budget"))
        .otherwise(F.lit("mixed"))
        .alias("budget"),
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("n_candidates").alias("n_candidates"),
    )
    if elapsed_seconds:
        out = (
            out.withColumn("elapsed_seconds", F.lit(float(elapsed_seconds)))
            .withColumn("queries_per_second", F.col("n_queries") / float(elapsed_seconds))
            .withColumn("candidates_per_second", F.col("n_candidates") / float(elapsed_seconds))
        )
    return out


def baseline_delta(headline: DataFrame, baseline_run: str) -> DataFrame:
    """Primary metric of every run minus the baseline run's."""
    base = headline.filter(F.col("run") == baseline_run).select(
        F.col("primary_metric").alias("b")
    ).scalar()
    return headline.filter(F.col("run") != baseline_run).select(
        "run", "primary_metric", (F.col("primary_metric") - base).alias("delta")
    )
