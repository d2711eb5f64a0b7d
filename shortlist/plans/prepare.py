"""Corpus jobs: prepare a shard, price a size cap, describe a training mix, encode tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import order_key
from ..operators import prep
from ..operators.arms import mix_summary
from ..operators.order import nested_prefix, random_split, sample_with_scale, weighted_draws
from ..session import materialize
from ..sources.corpus import write_splits


def prepare_corpus(
    records: DataFrame,
    rules: Sequence[tuple[str, Column]],
    *,
    canonical: str = "canonical",
    item: str = "item_id",
    group: str = "group_key",
    subset: str = "full",
    seed: int = 0,
    valid_frac: float = 0.05,
    test_frac: float = 0.05,
    blocked: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Rules, dedup, nested subset, exclusion, both splits and the shard summary.

    Exclusion comes after the subset is cut, so an excluded shard is smaller
    than its target.
    """
    if subset not in prep.SUBSETS:
        raise ValueError(f"unknown subset {subset!r}; expected one of {sorted(prep.SUBSETS)}")
    keyed = prep.with_digest(records, canonical).withColumn(
        "order_key", order_key(f"seed{seed}", F.col(item))
    )
    judged = prep.rule_chain(keyed, rules, F.col(canonical), out="__kept")
    reasons = prep.drop_reasons(judged)
    kept = prep.first_seen(
        judged.filter(F.col("reason") == "ok").drop("reason", "__kept"),
        "digest",
        ["order_key", item],
    )
    target = prep.SUBSETS[subset]
    if target is not None:
        kept = nested_prefix(kept, "order_key", item, target).drop("rank")
    kept = materialize(kept, "kept")
    removed = None
    members = kept
    if blocked is not None:
        removed = prep.excluded(kept, blocked, canonical)
        members = prep.exclude(kept, blocked, canonical)
    split_key = members.withColumn("__k", order_key(f"seed{seed + 1}", F.col(item)))
    splits = random_split(split_key, "__k", item, valid_frac, test_frac).drop("__k")
    grouped = prep.group_split(
        members, group, valid_frac, test_frac, f"seed{seed + 2}"
    )
    out = {
        "items": splits.join(grouped.select(item, "group_split"), item),
        "reasons": reasons,
        "consumed": prep.consumed_counts(reasons),
        "meta": prep.shard_meta(splits, grouped, reasons),
    }
    if removed is not None:
        out["excluded"] = removed
    return out


def write_shard(prepared: dict[str, DataFrame], path: str, *, overwrite: bool = False) -> bool:
    """Write a shard; one that is complete already is left alone unless told otherwise."""
    spark = prepared["items"].sparkSession
    meta = f"{path}/meta"
    if not overwrite:
        try:
            spark.read.json(meta).schema
            return False
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything else may hide a complete shard
                raise
    items = prepared["items"]
    write_splits(items, f"{path}/splits", mode="overwrite")
    write_splits(items, f"{path}/group_splits", column="group_split", mode="overwrite")
    if "excluded" in prepared:
        prepared["excluded"].write.mode("overwrite").parquet(f"{path}/excluded")
    # The summary goes last: its presence marks the shard as complete.
    prepared["meta"].write.mode("overwrite").json(meta)
    return True


def cap_cost(
    rows: DataFrame,
    cfg_rules,
    *,
    text: str,
    size: str,
    n_tokens: str,
    cap: int,
    raised: int,
    sample: int,
    yield_sample: int,
    seed: str,
    item: str = "item_id",
) -> dict[str, DataFrame]:
    """Share of the corpus above a size cap, and what raising the cap would admit.

    ``cfg_rules(cap)`` gives the rule chain at a cap.
    """
    sampled = sample_with_scale(rows, sample, f"{seed}-a", item)
    scale = F.coalesce(sampled.agg(F.max("scale").alias("s")).scalar(), F.lit(1.0))
    summary = prep.cap_summary(prep.size_histogram(sampled, size), size, cap, scale)
    long = sample_with_scale(prep.long_enough(rows, text, cap), yield_sample, f"{seed}-b", item)
    fates = prep.raised_cap_fates(long, cfg_rules(cap), cfg_rules(raised), size, n_tokens)
    long_scale = F.coalesce(long.agg(F.max("scale").alias("s")).scalar(), F.lit(1.0))
    return {
        "summary": summary,
        "tail": prep.tail_bands(summary),
        "fates": fates.withColumn("scale", long_scale).withColumn(
            "implied", F.bround(F.col("n") * F.col("scale")).cast("long")
        ),
    }


def weighted_mix(
    train: DataFrame, size: str, threshold: int, factor: float, bands: str, seed: str,
    item: str = "item_id",
) -> dict[str, DataFrame]:
    """Band shares before and after weighting, and one epoch of draws."""
    return {
        "summary": mix_summary(train, size, threshold, factor, bands),
        "draws": weighted_draws(train, item, size, threshold, factor, seed),
    }


def token_dataset(
    items: DataFrame,
    text: str,
    *,
    item: str = "item_id",
    pattern: str = tx.TOKEN_PATTERN,
    min_count: int = 1,
    max_tokens: int | None = 128,
    batch: str | None = None,
    vocab: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, vocabulary)``: encoded ids in chunks, padded per ``batch`` with a mask.

    A row holds at most ``max_tokens`` ids (all of an item's where it is None); what is
    longer goes on in the item's next ``chunk``, so no id is lost.
    The batch width is an aggregate joined back, so no batch is gathered anywhere.
    """
    tokens = items.withColumn("__t", tx.tokenize_strict(F.col(text), pattern))
    words = vocab if vocab is not None else tx.build_vocabulary(tokens, "__t", min_count)
    encoded = tx.encode(tokens, item, "__t", words)
    ids = F.col("ids")
    chunks = F.array(ids) if max_tokens is None else F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ids) / max_tokens) - 1, F.lit(0))),
        lambda c: F.slice(ids, (c * max_tokens + 1).cast("int"), max_tokens),
    )
    limited = encoded.select(
        *[F.col(c) for c in encoded.columns if c != "ids"], F.posexplode(chunks).alias("chunk", "tokens")
    )
    if batch is None:
        return limited, words
    rows = limited.join(items.select(item, batch), item)
    widths = rows.groupBy(batch).agg(F.max(F.size("tokens")).alias("width"))
    padded = rows.join(widths, batch).withColumn(
        "mask", tx.pad_mask(F.col("tokens"), F.col("width"))
    )
    return (
        padded.withColumn("tokens", tx.pad_to(F.col("tokens"), F.col("width"), tx.PAD_ID)),
        words,
    )
