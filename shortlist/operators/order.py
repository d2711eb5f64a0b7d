"""Global order without a single-task sort: ranks, prefixes, splits, samples.

A window without a partition key runs on one task.  Here the order key is a
uniform hash, so its leading bits cut the data into even ranges: count each
range, turn the counts into offsets, and number the rows inside each range.
The offsets table has at most ``2**bucket_bits`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import ORDER_BITS, order_key, unit_interval

#: Ranges of a global order: 10**11 rows come to some millions each.
BUCKET_BITS = 14
#: Share of a hash order that is read first, and how much more each further step reads.
FIRST_SHARE, GROWTH = 1 / 256, 4


def _hash_range(key: Column, bits: int) -> Column:
    return F.shiftright(key, ORDER_BITS - bits).cast("int")


def rank_in_ranges(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column],
    *,
    by: Sequence[str] = (),
    out: str = "rank",
    limit: int | None = None,
) -> DataFrame:
    """1-based rank of every row within ``by``.

    ``bucket`` must not decrease along ``order``.  Only buckets that can hold a
    rank up to ``limit`` are read further.
    """
    by = list(by)
    keyed = df.withColumn("__bucket", bucket)
    sizes = keyed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[F.col(c).alias(f"__o_{c}") for c in by],
        F.col("__bucket").alias("__o_bucket"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    if limit is not None:
        offsets = offsets.filter(F.col("__offset") < limit)
    condition = F.col("__bucket") == F.col("__o_bucket")
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    joined = keyed.join(offsets, condition)
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order)
    ranked = joined.withColumn(out, F.row_number().over(inside) + F.col("__offset"))
    ranked = ranked.drop("__bucket", "__o_bucket", "__offset", *[f"__o_{c}" for c in by])
    return ranked if limit is None else ranked.filter(F.col(out) <= limit)


def global_rank(
    df: DataFrame,
    key: str,
    tie: str,
    *,
    by: Sequence[str] = (),
    out: str = "rank",
    limit: int | None = None,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """Rank by a 60-bit hash key, ties by ``tie``."""
    return rank_in_ranges(
        df,
        _hash_range(F.col(key), bucket_bits),
        [F.col(key), F.col(tie)],
        by=by,
        out=out,
        limit=limit,
    )


def renumber(
    df: DataFrame, by: Sequence[str], pos: str, *, out: str | None = None, span: int = 4096
) -> DataFrame:
    """0-based position within ``by`` after rows were dropped.

    ``pos`` is unique within a group, so a range of ``span`` positions never
    holds more than ``span`` rows, however large the group is.
    """
    ranked = rank_in_ranges(
        df, F.floor(F.col(pos) / span), [F.col(pos)], by=by, out="__rank"
    )
    return ranked.withColumn(out or pos, (F.col("__rank") - 1).cast("long")).drop("__rank")


def preceding_total(
    df: DataFrame, key: str, tie: str, value: str, out: str, bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """Sum of ``value`` over all rows before this one in hash order."""
    keyed = df.withColumn("__bucket", _hash_range(F.col(key), bucket_bits))
    sizes = keyed.groupBy("__bucket").agg(F.sum(value).alias("__n"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")
    )
    inside = (
        Window.partitionBy("__bucket")
        .orderBy(key, tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.join(offsets, "__bucket")
        .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__offset"))
        .drop("__bucket", "__offset")
    )


def vocabulary_rank(df: DataFrame, token: str, out: str = "rank") -> DataFrame:
    """Rank of distinct strings in binary text order.

    The first two bytes of the UTF-8 form give an order-preserving bucket of
    bounded count; a bucket holds the distinct strings under one prefix.
    """
    prefix = F.conv(
        F.rpad(F.substring(F.hex(F.encode(F.col(token), "UTF-8")), 1, 4), 4, "0"), 16, 10
    ).cast("long")
    return rank_in_ranges(df, prefix, [F.col(token)], out=out)


def nested_prefix(
    df: DataFrame, key: str, tie: str, n: int | None, *, out: str = "rank"
) -> DataFrame:
    """First ``n`` rows in the shared order; a smaller ``n`` gives a subset."""
    return global_rank(df, key, tie, out=out, limit=n)


def head_of_order(df: DataFrame, key: str, kept: str, enough: int) -> DataFrame:
    """Rows of the least hash range, in steps of ``GROWTH``, that holds ``enough`` kept rows.

    Keys are uniform, so a step's count decides whether the next, larger range is needed; rows
    behind the range are never ranked.  The whole table is the last step.
    """
    share = FIRST_SHARE
    while share < 1:
        head = df.filter(F.col(key) < int(share * 2**ORDER_BITS))
        if (head.agg(F.sum(F.col(kept).cast("long"))).first()[0] or 0) >= enough:
            return head
        share *= GROWTH
    return df


def chunked_prefix(
    df: DataFrame, key: str, tie: str, kept: str, n: int, chunk: int
) -> DataFrame:
    """Rows kept when the target is tested only after each ``chunk`` records.

    ``df`` holds every record read, ``kept`` flags those that survive; whole
    chunks are taken until the survivors reach ``n``, so the result overshoots.
    Only the head of the order that is sure to hold them is ranked.
    """
    # chunks cut by the head's end hold less than a chunk of survivors
    ranked = global_rank(head_of_order(df, key, kept, n + chunk), key, tie, out="__read").withColumn(
        "__chunk", F.floor((F.col("__read") - 1) / chunk)
    )
    per_chunk = ranked.groupBy("__chunk").agg(
        F.sum(F.col(kept).cast("long")).alias("__kept")
    )
    # A range of 4096 chunks is numbered per task, then shifted by the ranges before it.
    spans = per_chunk.withColumn("__span", F.floor(F.col("__chunk") / 4096))
    span_sizes = spans.groupBy("__span").agg(F.sum("__kept").alias("__s"))
    earlier = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    span_offsets = span_sizes.select(
        "__span", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__so")
    )
    inside = (
        Window.partitionBy("__span")
        .orderBy("__chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = (
        spans.join(span_offsets, "__span")
        .withColumn(
            "__before", F.coalesce(F.sum("__kept").over(inside), F.lit(0)) + F.col("__so")
        )
        .filter(F.col("__before") < n)
        .select("__chunk")
    )
    return (
        ranked.join(needed, "__chunk")
        .filter(F.col(kept))
        .drop("__chunk")
        .withColumnRenamed("__read", "read_rank")
    )


def row_count(df: DataFrame) -> Column:
    """Row count as a scalar subquery, evaluated inside the plan."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def random_split(
    df: DataFrame,
    key: str,
    tie: str,
    valid_frac: float,
    test_frac: float,
    *,
    out: str = "split",
) -> DataFrame:
    """Floor-sized test, valid and train parts in hash order."""
    n = row_count(df)
    n_test = F.floor(n * test_frac)
    n_valid = F.floor(n * valid_frac)
    ranked = global_rank(df, key, tie, out="split_rank")
    return ranked.withColumn(
        out,
        F.when(F.col("split_rank") <= n_test, F.lit("test"))
        .when(F.col("split_rank") <= n_test + n_valid, F.lit("valid"))
        .otherwise(F.lit("train")),
    )


def sample_exact(
    df: DataFrame, n: int, seed: str, item: str, *, out: str = "draw"
) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run and cluster."""
    keyed = df.withColumn("__h", order_key(seed, F.col(item)))
    return global_rank(keyed, "__h", item, out=out, limit=n).drop("__h")


def sample_with_scale(df: DataFrame, n: int, seed: str, item: str) -> DataFrame:
    """A sample of ``n`` with the stream length and the factor back to the whole."""
    total = row_count(df)
    return (
        sample_exact(df, n, seed, item)
        .withColumn("stream_length", total)
        .withColumn("scale", F.col("stream_length") / F.least(F.col("stream_length"), F.lit(n)))
    )


def stratified_sample(
    df: DataFrame, stratum: str, per_stratum: int, seed: str, item: str
) -> DataFrame:
    """Up to ``per_stratum`` rows of every stratum."""
    keyed = df.withColumn("__h", order_key(seed, F.col(item)))
    return global_rank(
        keyed, "__h", item, by=[stratum], out="draw", limit=per_stratum
    ).drop("__h")


def threshold_weights(size: Column, threshold: int, factor: float) -> Column:
    if factor <= 0:
        raise ValueError(f"factor must be positive, got {factor}")
    return F.when(size >= threshold, F.lit(float(factor))).otherwise(F.lit(1.0))


def weighted_draws(
    df: DataFrame, item: str, size: str, threshold: int, factor: float, seed: str
) -> DataFrame:
    """As many draws with replacement as rows, at or above ``threshold`` more likely.

    Weights take two values, so a draw is a stratum picked by weight and then a
    uniform rank inside it: an equi-join on (stratum, rank), with no range join
    over cumulative weights.  Ranks are uniform, so the join keys are even.
    """
    threshold_weights(F.col(size), threshold, factor)
    strata = df.select(item, size).withColumn("heavy", F.col(size) >= threshold)
    keyed = strata.withColumn("__h", order_key(seed, "stratum", F.col(item)))
    members = global_rank(keyed, "__h", item, by=["heavy"], out="rank").drop("__h")
    totals = strata.agg(
        F.count_if("heavy").alias("n_heavy"), F.count_if(~F.col("heavy")).alias("n_light")
    )
    n_heavy = totals.select("n_heavy").scalar()
    n_light = totals.select("n_light").scalar()
    draws = (
        strata.select(F.col(item).alias("draw"))
        .withColumn("__nh", n_heavy)
        .withColumn("__nl", n_light)
        .withColumn(
            "heavy",
            unit_interval(seed, "which", F.col("draw"))
            * (F.col("__nh") * float(factor) + F.col("__nl"))
            < F.col("__nh") * float(factor),
        )
        .withColumn("__m", F.when(F.col("heavy"), F.col("__nh")).otherwise(F.col("__nl")))
        .withColumn(
            "rank",
            F.floor(unit_interval(seed, "rank", F.col("draw")) * F.col("__m")) + 1,
        )
        .select("draw", "heavy", "rank")
    )
    return draws.join(members, ["heavy", "rank"]).select("draw", item, size, "heavy")
