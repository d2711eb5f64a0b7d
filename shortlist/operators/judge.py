"""Judging and ordering candidates.

Candidate groups can be very uneven: one query may own a third of all rows.
First occurrences and votes are therefore aggregates that combine inside each
input task, and lists cut at k use a window filter Spark applies before the
shuffle.  No step sorts a whole query's candidates in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import tanimoto_maps
from ..session import materialize
from .order import renumber

QUERY = ("run", "query_id")
BUDGETS = ("molecules", "strings")
ORDERS = ("generation", "consensus")
DEDUPE_MODES = ("canonical", "raw", "none")
#: Positions of a query's candidates that are judged under one join key.
SPAN = 4096
#: Positions of a query's candidates that are numbered by one sort.
RANKED = 1 << 20


def _check(value: str, allowed: Sequence[str], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; expected one of {tuple(allowed)}")


def raw_dedup(
    cands: DataFrame, by: Sequence[str] = QUERY, raw: str = "raw", pos: str = "pos"
) -> DataFrame:
    """Drop byte-identical repeats within a query and close the gaps in ``pos``."""
    if set(cands.columns) == {*by, raw, pos}:
        firsts = cands.groupBy(*by, raw).agg(F.min(pos).alias(pos))
    else:
        w = Window.partitionBy(*by, raw).orderBy(pos)
        firsts = (
            cands.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
        )
    return renumber(firsts, by, pos, span=RANKED)


def judge(
    cands: DataFrame,
    targets: DataFrame,
    *,
    query: str = "query_id",
    cand_key: str = "key",
    cand_map: str = "fmap",
    canonical: str = "canonical",
    target_key: str = "target_key",
    target_map: str = "target_map",
    target_canonical: str = "target_canonical",
    pos: str = "pos",
    span: int = SPAN,
) -> DataFrame:
    """Verdict of every candidate against its query's target.

    A query's candidates meet its target in stretches of ``span`` positions, so that one query
    with any number of candidates is as many join keys; a target is copied once per stretch.
    """
    stretch = F.floor(F.col(pos) / span).alias("__stretch")
    split = cands.select("*", stretch)
    used = split.select(query, "__stretch").distinct()
    copies = targets.select(query, target_key, target_map, target_canonical).join(used, query)
    joined = split.join(copies, [query, "__stretch"]).drop("__stretch")
    valid = F.col(canonical).isNotNull()
    return (
        joined.withColumn("valid", valid)
        .withColumn(
            "fp_match", valid & F.coalesce(F.col(cand_key) == F.col(target_key), F.lit(False))
        )
        .withColumn(
            "exact_structure",
            valid & F.coalesce(F.col(canonical) == F.col(target_canonical), F.lit(False)),
        )
        .withColumn(
            "tanimoto",
            F.when(valid, tanimoto_maps(F.col(cand_map), F.col(target_map))).otherwise(F.lit(0.0)),
        )
        .drop(target_key, target_map, target_canonical, cand_map, cand_key)
    )


def mark_duplicates(
    judged: DataFrame,
    by: Sequence[str] = QUERY,
    canonical: str = "canonical",
    pos: str = "pos",
    mode: str = "canonical",
) -> DataFrame:
    """Flag later spellings of an item already proposed; rows without a canonical never are."""
    _check(mode, DEDUPE_MODES, "dedupe mode")
    if mode != "canonical":
        return judged.withColumn("duplicate", F.lit(False))
    firsts = (
        judged.filter(F.col(canonical).isNotNull())
        .groupBy(*by, canonical)
        .agg(F.min(pos).alias("__first"))
    )
    return judged.join(firsts, [*by, canonical], "left").withColumn(
        "duplicate", F.coalesce(F.col(pos) > F.col("__first"), F.lit(False))
    ).drop("__first")


def check_many(
    cands: DataFrame,
    targets: DataFrame,
    by: Sequence[str] = QUERY,
    mode: str = "canonical",
) -> DataFrame:
    """Drop raw repeats, judge, mark repeats of an item: in that order, cheapest first."""
    _check(mode, DEDUPE_MODES, "dedupe mode")
    rows = cands if mode == "none" else raw_dedup(cands, by)
    return mark_duplicates(judge(rows, targets), by, mode=mode)


def is_scored(budget: str) -> Column:
    """Does a row take one of the k slots?"""
    _check(budget, BUDGETS, "budget")
    fresh = ~F.col("duplicate")
    return (F.col("valid") & fresh) if budget == "molecules" else fresh


#: An item by its canonical form, or an invalid row by its position: two columns, so that no
#: canonical form can be taken for a position.
SLOT = ("__slot", "__alone")


def slot_keys() -> list[Column]:
    item = F.when(F.col("valid"), F.col("canonical"))
    return [item.alias(SLOT[0]), F.when(item.isNull(), F.col("pos")).alias(SLOT[1])]


def proposals(judged: DataFrame, budget: str = "molecules") -> DataFrame:
    """One row per proposed item: its first position, its votes, its verdict.

    Votes count every valid spelling, repeats included.  Under the ``strings``
    budget an invalid string is a proposal of its own with no votes.
    """
    _check(budget, BUDGETS, "budget")
    rows = judged.filter(F.col("pos").isNotNull())
    if budget == "molecules":
        rows = rows.filter("valid")
    return (
        rows.select("*", *slot_keys())
        .groupBy(*QUERY, *SLOT)
        .agg(
            F.min("pos").alias("first_pos"),
            F.count_if(F.col("valid") & F.col("canonical").isNotNull()).alias("votes"),
            F.max(F.col("fp_match").cast("int")).alias("fp_match"),
            F.max(F.col("exact_structure").cast("int")).alias("exact_structure"),
            F.max("tanimoto").alias("tanimoto"),
            F.max("cand_size").alias("cand_size"),
        )
        .withColumn("canonical", F.coalesce("__slot", F.concat(F.lit("#"), F.col("__alone").cast("string"))))
        .drop(*SLOT)
    )


def ordering(order: str) -> list[Column]:
    """Total order of proposals; consensus is stable on first position."""
    _check(order, ORDERS, "order")
    if order == "consensus":
        return [F.col("votes").desc(), F.col("first_pos").asc()]
    return [F.col("first_pos").asc()]


def slots(
    judged: DataFrame, k: int, budget: str = "molecules", order: str = "generation"
) -> DataFrame:
    """The first k proposals of every query with a 0-based ``slot``."""
    w = Window.partitionBy(*QUERY).orderBy(*ordering(order))
    return (
        proposals(judged, budget)
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= k)
        .withColumn("slot", F.col("__rn") - 1)
        .drop("__rn")
    )


def top_candidates(judged: DataFrame, k: int, verified_only: bool = False) -> DataFrame:
    """First k distinct candidates by match, votes, similarity, then position."""
    rows = proposals(judged.filter("valid"))
    if verified_only:
        rows = rows.filter(F.col("fp_match") == 1)
    w = Window.partitionBy(*QUERY).orderBy(
        F.desc("fp_match"), F.desc("votes"), F.desc("tanimoto"), F.asc("first_pos")
    )
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_result(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Best candidate per query, first wins; null for a query without candidates."""
    w = Window.partitionBy(*QUERY).orderBy(
        F.desc("fp_match"), F.desc("exact_structure"), F.desc("tanimoto"), F.asc("pos")
    )
    best = (
        judged.filter(F.col("pos").isNotNull())
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") == 1)
        .select(*QUERY, "pos", "fp_match", "exact_structure", "tanimoto")
    )
    return queries.select(*QUERY).join(best, list(QUERY), "left")


def pool_arms(judged: DataFrame, arms: Sequence[str], pooled_run: str = "pooled") -> DataFrame:
    """Candidates of several arms as one list, arm order first, then deduplicated.

    Positions of arm i follow every position of the arms before it.
    """
    arm = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("run")) - 1
    widened = (
        judged.filter(F.col("run").isin(*arms))
        .withColumn("pos", arm * F.lit(2**40) + F.col("pos"))
        .withColumn("run", F.lit(pooled_run))
        .drop("duplicate")
    )
    return mark_duplicates(materialize(raw_dedup(widened), "pooled"))


def draws_to_fill(
    draws: DataFrame, k: int, first_round: int, round_size: int, cap: int, queries: DataFrame | None = None
):
    """Rounds of sampling until k distinct valid items are held or the cap stops it.

    ``draws`` holds ``run, query_id, pos, canonical`` (canonical null when
    invalid) for raw draws, repeats included.  ``queries`` adds those without a draw.  The answer needs only the k-th first occurrence, so the running
    count is cut at k rows per query before the shuffle.
    """
    firsts = (
        draws.filter(F.col("canonical").isNotNull())
        .groupBy(*QUERY, "canonical")
        .agg(F.min("pos").alias("first_pos"))
    )
    w = Window.partitionBy(*QUERY).orderBy("first_pos")
    kth = (
        firsts.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= k)
        .groupBy(*QUERY)
        .agg(F.max("__rn").alias("held"), F.max("first_pos").alias("kth_pos"))
    )
    most_rounds = max(0, (cap - first_round) // round_size)
    needed = F.greatest(
        F.ceil((F.col("kth_pos") + 1 - first_round) / round_size), F.lit(0)
    )
    rounds = F.when(
        (F.col("held") >= k) & (needed <= most_rounds), needed
    ).otherwise(F.lit(most_rounds)).cast("int")
    stopped = F.when(
        (F.col("held") >= k) & (needed <= most_rounds), F.lit("filled")
    ).otherwise(F.lit("cap"))
    base = (draws if queries is None else queries).select(*QUERY).distinct()
    return base.join(kth, list(QUERY), "left").select(
        *QUERY,
        F.coalesce(rounds, F.lit(most_rounds)).alias("topup_rounds"),
        (first_round + F.coalesce(rounds, F.lit(most_rounds)) * round_size).alias("drawn"),
        F.coalesce(stopped, F.lit("cap")).alias("stopped"),
    )
