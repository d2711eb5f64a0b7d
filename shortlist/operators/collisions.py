"""How many items share a feature key: profiles, folding loss, ambiguity by band.

Keys are counted before anything is spread back over items, so a key shared by a
third of the corpus is one partial count per task, never one task's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.bands import DEFAULT_BANDS, explode_bands
from ..functions.features import FeatureConfig


def collision_profile(features: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row for one mode; ``features`` holds ``item_id, key, n_set, mass``."""
    # Mean, min and max fold over keys; the median needs the exact counts of each width.
    per_key = features.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("n_set").alias("n_set"),
        F.sum("mass").alias("mass"),
    )
    n = F.col("n")
    items = F.sum("n")
    return per_key.agg(
        F.lit(cfg.describe()).alias("mode"),
        F.lit(cfg.config_id).alias("config_id"),
        items.alias("n_items"),
        F.count(F.lit(1)).alias("n_distinct_keys"),
        (F.count_if(n == 1) / items).alias("frac_uniquely_determined"),
        F.max("n").alias("max_items_per_key"),
        F.avg("n").alias("mean_items_per_key"),
        (F.sum(F.col("n_set") * n) / items).alias("bits_mean"),
        F.min("n_set").alias("bits_min"),
        F.max("n_set").alias("bits_max"),
        F.percentile("n_set", 0.5, F.col("n")).alias("bits_median"),
        (
            F.sum(F.col("n_set") * n) / items / cfg.n_bits
            if cfg.folded
            else F.lit(None).cast("double")
        ).alias("mean_density"),
        (F.sum("mass") / items).alias("mean_count_mass"),
    )


def group_size_histogram(features: DataFrame) -> DataFrame:
    """``items_per_key, n_keys``."""
    return (
        features.groupBy("key")
        .agg(F.count(F.lit(1)).alias("items_per_key"))
        .groupBy("items_per_key")
        .agg(F.count(F.lit(1)).alias("n_keys"))
    )


def folding_loss(rows: DataFrame, true_size: str, kept_size: str) -> DataFrame:
    """Features lost to folding, per corpus."""
    lost = F.col(true_size) - F.col(kept_size)
    return rows.agg(
        F.avg(true_size).alias("mean_true"),
        F.avg(kept_size).alias("mean_kept"),
        F.avg(lost).alias("mean_lost"),
        stats.safe_ratio(F.sum(lost), F.sum(true_size), 0.0).alias("frac_lost"),
        F.avg((lost > 0).cast("double")).alias("frac_with_any_collision"),
    )


def twin_counts(items: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """``key, size, n, twins``: items per (key, size), and items per key beside it."""
    cells = items.groupBy(key, size).agg(F.count(F.lit(1)).alias("n"))
    # After counting, a key has one row per distinct size, whatever its item count.
    return cells.withColumn("twins", F.sum("n").over(Window.partitionBy(key)))


def ambiguity_by_band(
    items: DataFrame, key: str = "key", size: str = "size", bands: str = DEFAULT_BANDS
) -> DataFrame:
    """Items whose key some other item shares, per size band; items are distinct already."""
    n, twins = F.col("n"), F.col("twins")
    total = F.sum("n")
    return (
        explode_bands(twin_counts(items, key, size), size, bands)
        .groupBy("band")
        .agg(
            total.alias("items"),
            F.coalesce(F.sum(F.when(twins > 1, n)), F.lit(0)).alias("ambiguous"),
            (F.coalesce(F.sum(F.when(twins > 1, n)), F.lit(0)) / total).alias("ambiguous_rate"),
            (F.sum(n * twins) / total).alias("mean_group_size"),
            F.max(twins).alias("max_group_size"),
        )
    )


def query_twins(
    queries: DataFrame, corpus: DataFrame, key: str = "key", identity: str = "canonical"
) -> DataFrame:
    """Corpus items sharing a query's key, the query's own item not counted."""
    per_key = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    members = corpus.select(identity).distinct().withColumn("__member", F.lit(1))
    return (
        queries.join(per_key, key, "left")
        .join(members, identity, "left")
        .withColumn(
            "twins",
            F.greatest(
                F.coalesce("__n", F.lit(0)) - F.coalesce("__member", F.lit(0)), F.lit(0)
            ),
        )
        .drop("__n", "__member")
    )


def profile_delta(profiles: DataFrame, base_mode: str, other_mode: str) -> Column:
    """Uniquely determined share of one mode minus another's, as a scalar."""
    share = lambda m: profiles.filter(F.col("mode") == m).select(
        "frac_uniquely_determined"
    ).scalar()
    return share(other_mode) - share(base_mode)
