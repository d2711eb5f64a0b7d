"""Retrieval jobs: a nearest-item baseline, re-judging, perturbed queries, feature profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import FeatureConfig, feature_set, perturb, set_key, tanimoto_sets
from ..operators import collisions, metrics
from ..operators.judge import mark_duplicates
from ..operators.retrieve import seen_flag, tanimoto_topk

RUN = "nearest"


def retrieve_and_judge(
    queries: DataFrame,
    index: DataFrame,
    k: int,
) -> tuple[DataFrame, DataFrame]:
    """``(queries, judged)`` of the retrieval run.

    ``queries`` holds ``query_id, canonical, key, bits, size``; ``index`` holds
    ``item_id, canonical, key, bits, pos``.
    """
    found = tanimoto_topk(queries, index, k)
    targets = queries.select(
        "query_id", F.col("key").alias("q_key"), F.col("canonical").alias("q_canonical")
    )
    members = index.select(
        "item_id", F.col("canonical").alias("c_canonical"), F.col("key").alias("c_key"),
        F.size("bits").alias("cand_size"),
    )
    judged = (
        found.join(members, "item_id")
        .join(targets, "query_id")
        .select(
            F.lit(RUN).alias("run"),
            "query_id",
            (F.col("rank") - 1).cast("long").alias("pos"),
            F.col("item_id").cast("string").alias("raw"),
            F.col("c_canonical").alias("canonical"),
            F.lit(True).alias("valid"),
            (F.col("c_key") == F.col("q_key")).alias("fp_match"),
            (F.col("c_canonical") == F.col("q_canonical")).alias("exact_structure"),
            F.col("similarity").alias("tanimoto"),
            "cand_size",
        )
    )
    flagged = seen_flag(queries, index, "key").select(
        F.lit(RUN).alias("run"),
        "query_id",
        F.col("size").cast("int").alias("size"),
        "fp_unseen",
        F.lit(k).alias("n_samples"),
    )
    return flagged, mark_duplicates(judged)


def retrieval_baseline(
    queries: DataFrame, index: DataFrame, k: int, ks: Sequence[int]
) -> DataFrame:
    """Metric report of nearest-item retrieval on the queries a model would be scored on."""
    q, judged = retrieve_and_judge(queries, index, k)
    return metrics.recovery_report(metrics.query_summary(q, judged), ks)


def rejudge(
    judged: DataFrame,
    queries: DataFrame,
    items: DataFrame,
    other: FeatureConfig,
    ks: Sequence[int],
    *,
    tokens: str = "tokens",
) -> DataFrame:
    """Recovery of one candidate list under its own features and under another configuration.

    ``items`` gives the candidates' tokens by ``canonical``, ``queries`` the
    targets' tokens; only digests of the new features travel through the joins.
    """
    new_key = set_key(feature_set(F.col(tokens), other))
    cand = items.select("canonical", new_key.alias("__ck")).dropDuplicates(["canonical"])
    target = queries.select("query_id", new_key.alias("__tk"))
    scored = judged.filter(F.col("valid") & ~F.col("duplicate"))
    hits = (
        scored.join(cand, "canonical", "left")
        .join(target, "query_id")
        .groupBy("run", "query_id")
        .agg(
            F.min(F.when(F.col("fp_match"), F.col("pos"))).alias("own"),
            F.min(F.when(F.col("__ck") == F.col("__tk"), F.col("pos"))).alias("other"),
        )
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.avg(F.coalesce(F.col("own") < k, F.lit(False)).cast("double")).alias("own"),
                F.avg(F.coalesce(F.col("other") < k, F.lit(False)).cast("double")).alias("other"),
            )
            for k in ks
        ]
    )
    base = target.select("query_id")
    return (
        base.join(hits, "query_id", "left")
        .agg(cells.alias("c"))
        .select(F.explode("c").alias("c"))
        .select("c.*")
    )


def perturbation_conditions(modes: Sequence[str], sizes: Sequence[int]) -> list[tuple[str, str, int]]:
    """``(name, mode, n)``; the unperturbed condition appears once."""
    out = []
    for mode in modes:
        for n in sizes:
            if n == 0 and mode != modes[0]:
                continue
            out.append(("none" if n == 0 else f"{mode}{n}", mode, n))
    return out


def perturbed_queries(
    queries: DataFrame, cfg: FeatureConfig, conditions: Sequence[tuple[str, str, int]], seed: str
) -> DataFrame:
    """``condition, query_id, bits, key`` beside the original ``o_bits, o_key, canonical``."""
    if cfg.counts:
        raise ValueError("bits can be flipped in binary features only")
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("condition"),
                (
                    perturb(F.col("bits"), F.col("query_id"), mode, n, cfg.n_bits, seed)
                    if n
                    else F.col("bits")
                ).alias("p_bits"),
            )
            for name, mode, n in conditions
        ]
    )
    return (
        queries.select(
            "query_id", "canonical", F.col("bits").alias("o_bits"), F.col("key").alias("o_key"),
            F.explode(cells).alias("c"),
        )
        .select(
            "c.condition", "query_id", "canonical", "o_bits", "o_key", F.col("c.p_bits").alias("bits")
        )
        .withColumn("key", set_key(F.col("bits")))
    )


def perturbation_probe(
    perturbed: DataFrame, index: DataFrame, k: int
) -> DataFrame:
    """What retrieval returns when the query's features are damaged, averaged per condition."""
    targets = perturbed.withColumn(
        "pid", F.concat_ws("#", "condition", F.col("query_id").cast("string"))
    )
    found = tanimoto_topk(targets, index, k, query="pid")
    own = F.col("c_canonical") == F.col("canonical")
    drift = tanimoto_sets(F.col("bits"), F.col("o_bits"))
    rows = (
        found.join(
            index.select(
                "item_id", F.col("canonical").alias("c_canonical"), F.col("key").alias("c_key"),
                F.col("bits").alias("c_bits"),
            ),
            "item_id",
        )
        .join(targets.drop("query_id"), "pid")
        .withColumn("original_similarity", tanimoto_sets(F.col("c_bits"), F.col("o_bits")))
        .withColumn("target_vs_original", drift)
        .drop("c_bits", "bits", "o_bits")
    )
    per_query = rows.groupBy("condition", "pid").agg(
        F.max((F.col("c_key") == F.col("key")).cast("double")).alias("hit_perturbed"),
        F.max((F.col("c_key") == F.col("o_key")).cast("double")).alias("hit_original_fp"),
        F.max(own.cast("double")).alias("exact_original"),
        F.max("similarity").alias("best_tan_perturbed"),
        F.max("original_similarity").alias("best_tan_original"),
        F.max("target_vs_original").alias("target_vs_original"),
        F.avg((~own).cast("double")).alias("novel_fraction"),
        F.max((~own & (F.col("similarity") > F.col("target_vs_original"))).cast("double")).alias(
            "beats_original_on_target"
        ),
        F.avg(F.col("c_canonical").isNotNull().cast("double")).alias("validity"),
        F.count_distinct("c_canonical").cast("double").alias("distinct"),
    )
    values = [c for c in per_query.columns if c not in ("condition", "pid")]
    return per_query.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in values]
    )


def recoverability(
    feature_tables: Sequence[tuple[FeatureConfig, DataFrame]],
) -> DataFrame:
    """Collision profile of several feature modes, one row each."""
    out = None
    for cfg, table in feature_tables:
        row = collisions.collision_profile(table, cfg)
        out = row if out is None else out.unionByName(row)
    return out
