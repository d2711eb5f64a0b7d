"""Key membership and exact top-k retrieval by set similarity.

Index and queries first collapse to distinct feature sets, so copies cost nothing.  A protocol's
query sample is small and goes to every task; any larger query table is cut by set length and meets
the index in bounded blocks (:mod:`similar`).  Both are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .minhash import near_scan, near_sets
from .similar import join_sets, scan_sets

#: Largest query table shipped to every task by one pass of the scan: about 60 MB.
SCAN_QUERIES = 20_000
SCAN_FEATURES = 5_000_000
#: Most passes over the index; a query table that needs more meets it in blocks, which moves the index
#: once per block and the queries once per chunk.
PASSES = 64


def seen_flag(
    queries: DataFrame, train: DataFrame, key: str = "key", out: str = "fp_unseen"
) -> DataFrame:
    """True when the query's key is absent from training."""
    keys = train.select(F.col(key).alias("__k")).distinct()
    return (
        queries.join(keys, F.col(key) == F.col("__k"), "left")
        .withColumn(out, F.col("__k").isNull())
        .drop("__k")
    )


def union_of_keys(*trains: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys over all training sets."""
    out = trains[0].select(key)
    for t in trains[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def clean_pool(pool: DataFrame, trains: DataFrame, on: str) -> DataFrame:
    """Rows found in nobody's training set."""
    return pool.join(trains.select(on).distinct(), on, "left_anti")


def contamination(held_out: DataFrame, train: DataFrame, on: str) -> DataFrame:
    """Held-out items of one shard inside another's training set."""
    leaked = held_out.join(train.select(on).distinct(), on, "left_semi")
    total = held_out.agg(F.count(F.lit(1)).alias("n")).scalar()
    return leaked.agg(F.count(F.lit(1)).alias("leaked")).withColumn("held_out", total)


def group_novelty(
    items: DataFrame, train: DataFrame, group: str, out: str = "group_seen"
) -> DataFrame:
    """Whether training knows the item's group; items without a group drop out."""
    known = train.select(F.col(group).alias("__g")).filter(F.col("__g").isNotNull()).distinct()
    return (
        items.filter(F.col(group).isNotNull())
        .join(known, F.col(group) == F.col("__g"), "left")
        .withColumn(out, F.col("__g").isNotNull())
        .drop("__g")
    )


def exact_lookup(
    queries: DataFrame, index: DataFrame, key: str = "key", item: str = "item_id", pos: str = "pos"
) -> DataFrame:
    """First index item with exactly the query's key, if there is one."""
    first = index.groupBy(key).agg(
        F.min_by(item, pos).alias("exact_item"), F.min(pos).alias("exact_pos")
    )
    return queries.join(first, key, "left")


def distinct_sets(index: DataFrame, key: str, bits: str, pos: str) -> DataFrame:
    """``set_key, n, bits, first_pos``: one row per distinct feature set."""
    w = Window.partitionBy(key).orderBy(pos)
    first = (
        index.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    )
    return first.select(
        F.col(key).alias("set_key"),
        F.size(bits).alias("n"),
        F.col(bits).alias("bits"),
        F.col(pos).alias("first_pos"),
    )


def listed_items(best: DataFrame, index: DataFrame, k: int, item: str, key: str, pos: str) -> DataFrame:
    """``q_key``, item, ``similarity``, ``__pos``, ``rank``: the first k items of a query's sets."""
    # Only the first k members of a set can be among the first k items.
    wm = Window.partitionBy("set_key").orderBy("__pos")
    members = (
        index.select(F.col(key).alias("set_key"), item, F.col(pos).alias("__pos"))
        .withColumn("__rn", F.row_number().over(wm))
        .filter(F.col("__rn") <= k)
        .select("set_key", item, "__pos")
    )
    found = best.join(members, "set_key").select("q_key", item, "similarity", "__pos")
    wq = Window.partitionBy("q_key").orderBy(F.desc("similarity"), F.asc("__pos"))
    return found.withColumn("rank", F.row_number().over(wq)).filter(F.col("rank") <= k)


def scan_passes(q_sets: DataFrame) -> int:
    """Passes over the index that a table of distinct query sets needs, 1 at least."""
    size = q_sets.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("features")).first()
    return max(1, -(-size["rows"] // SCAN_QUERIES), -(-(size["features"] or 0) // SCAN_FEATURES))


def near_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    least: float,
    *,
    query: str = "query_id",
    item: str = "item_id",
    key: str = "key",
    bits: str = "bits",
    pos: str = "pos",
) -> DataFrame:
    """Like :func:`tanimoto_topk`, of items at least ``least`` alike, found by banded min-hashes.

    Similarities are exact and no list holds a pair below ``least``; a pair may be missing with
    the small probability that :mod:`minhash` states.
    """
    index = materialize(index.select(*dict.fromkeys((item, key, bits, pos))), "index")
    queries = materialize(queries.select(*dict.fromkeys((query, key, bits))), "asked")
    q_sets = materialize(distinct_sets(queries.withColumn("__pos", F.col(query)), key, bits, "__pos"), "queries")
    sets, passes = distinct_sets(index, key, bits, pos), scan_passes(q_sets)
    best = near_scan(q_sets, sets, k, least, passes) if passes <= PASSES else near_sets(q_sets, sets, k, least)
    ranked = listed_items(best, index, k, item, key, pos)
    return queries.select(query, F.col(key).alias("q_key")).join(ranked, "q_key").select(
        query, item, "similarity", "rank"
    )


def tanimoto_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    query: str = "query_id",
    item: str = "item_id",
    key: str = "key",
    bits: str = "bits",
    pos: str = "pos",
    scan: bool | None = None,
) -> DataFrame:
    """``query_id, item_id, similarity, rank`` of the k most similar index items.

    Queries are shipped to every task, ``SCAN_QUERIES`` and ``SCAN_FEATURES`` at
    a time, and the index is read in place once per such pass.  A table that needs
    more than ``PASSES`` meets the index in blocks by set length.  Both are exact;
    ``scan`` forces one of them.

    An item with exactly the query's key comes first, then similarity
    downwards, ties in ``pos`` order.  When fewer than k items share a feature
    the list is filled in ``pos`` order with similarity 0.  ``pos`` is unique.
    """
    # features are computed once: several of the steps below read them
    index = materialize(index.select(*dict.fromkeys((item, key, bits, pos))), "index")
    queries = materialize(queries.select(*dict.fromkeys((query, key, bits))), "asked")
    sets = distinct_sets(index, key, bits, pos)
    q_index = queries.withColumn("__pos", F.col(query))
    q_sets = materialize(distinct_sets(q_index, key, bits, "__pos"), "queries")
    passes = scan_passes(q_sets)
    if scan is None:
        scan = passes <= PASSES
    elif scan and passes > PASSES:
        raise ValueError("too many queries to ship to every task; use scan=False")
    best = scan_sets(q_sets, sets, k, passes=passes) if scan else join_sets(q_sets, sets, k)
    ranked = materialize(listed_items(best, index, k, item, key, pos), "ranked")
    # Fill short lists from the head of the index: 2k rows hold k that are not listed yet.
    all_q = queries.select(F.col(key).alias("q_key")).distinct()
    short = (
        all_q.join(ranked.groupBy("q_key").agg(F.count(F.lit(1)).alias("have")), "q_key", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter(F.col("have") < k)
    )
    head = (
        index.select(item, F.col(pos).alias("__pos"))
        .orderBy("__pos")
        .limit(2 * k)
        .withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__pos")))
    )
    wf = Window.partitionBy("q_key").orderBy("__pos")
    fill = (
        short.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(2 * k))))
        .join(head, "slot")
        .join(ranked.select("q_key", item), ["q_key", item], "left_anti")
        .withColumn("__f", F.row_number().over(wf))
        .filter(F.col("__f") <= k)
        .withColumn("rank", (F.col("__f") + F.col("have")).cast("int"))
        .filter(F.col("rank") <= k)
        .select("q_key", item, F.lit(0.0).alias("similarity"), "__pos", "rank")
    )
    lists = ranked.unionByName(fill)
    return queries.select(query, F.col(key).alias("q_key")).join(lists, "q_key").select(
        query, item, "similarity", "rank"
    )


def multiset_bits(fmap: Column) -> Column:
    """Counts as a set: the i-th occurrence of a feature is an element of its own.

    Set Tanimoto over these elements equals sum of minima over sum of maxima, so
    count features use the same retrieval.
    """
    return F.array_sort(
        F.flatten(
            F.transform(
                F.map_entries(fmap),
                lambda e: F.transform(
                    F.sequence(F.lit(1), e["value"]),
                    lambda i: F.xxhash64(e["key"], i),
                ),
            )
        )
    )
