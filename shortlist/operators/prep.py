"""Corpus preparation: rule chains, first-seen dedup, exclusion, group splits, what-if caps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .order import preceding_total, row_count

# Named corpus sizes; None keeps everything.
SUBSETS = {"10k": 10_000, "100k": 100_000, "1m": 1_000_000, "full": None}
TAIL_EDGES = (69, 79, 99, 149)
READ_CHUNK = 2000


@dataclass(frozen=True)
class StandardizeConfig:
    """Bounds of the rule chain."""

    max_size: int = 64
    min_size: int = 3
    max_tokens: int = 128
    allowed: frozenset[str] = field(default_factory=frozenset)

    def to_dict(self) -> dict:
        return {**asdict(self), "allowed": sorted(self.allowed)}


def standard_rules(
    cfg: StandardizeConfig,
    *,
    parsed: Column,
    size: Column,
    kind: Column | None = None,
    canonical: Column,
    n_tokens: Column,
    tokenizable: Column | None = None,
    stable: Column | None = None,
) -> list[tuple[str, Column]]:
    """The ordered (reason, failing predicate) list for a config."""
    rules = [
        ("unparseable", ~parsed),
        ("too_small", size < cfg.min_size),
        ("too_large", size > cfg.max_size),
    ]
    if cfg.allowed and kind is not None:
        rules.append(("disallowed_element", ~kind.isin(*sorted(cfg.allowed))))
    rules.append(("empty", F.coalesce(canonical, F.lit("")) == ""))
    if tokenizable is not None:
        rules.append(("untokenizable", ~tokenizable))
    rules.append(("too_many_tokens", n_tokens > cfg.max_tokens))
    if stable is not None:
        rules.append(("unstable_canonical", ~stable))
    return rules


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first failing rule, ``ok`` when none fails; null predicates pass."""
    reason = F.lit("ok")
    for name, failing in reversed(list(rules)):
        reason = F.when(F.coalesce(failing, F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row ``inline``.

    A filter pushed below a plain projection copies its expressions, so a costly
    text expression would run again for every predicate that uses it.  Nothing
    is pushed below a generator's own output.
    """
    cells = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(cells)))


def rule_chain(
    df: DataFrame, rules: Sequence[tuple[str, Column]], canonical: Column, out: str = "canonical"
) -> DataFrame:
    """Add ``reason`` and the canonical form, which is null for dropped rows."""
    return df.withColumn("reason", first_reason(rules)).withColumn(
        out, F.when(F.col("reason") == "ok", canonical)
    )


def first_seen(
    df: DataFrame, identity: Sequence[str] | str, order: Sequence[str]
) -> DataFrame:
    """Keep the first row of every identity.

    The ``= 1`` filter lets Spark drop repeats inside each input task, so a text
    copied into a third of the corpus reaches the shuffle once per task.
    """
    keys = [identity] if isinstance(identity, str) else list(identity)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def with_digest(df: DataFrame, column: str, out: str = "digest") -> DataFrame:
    """128-bit digest, a narrow stand-in for a long text as a shuffle key."""
    return df.withColumn(out, F.md5(F.col(column)))


def drop_reasons(standardized: DataFrame, identity: str = "digest") -> DataFrame:
    """``reason, n`` with later copies of a kept item counted as ``duplicate`` as well.

    The legacy tally counts a duplicate under ``ok`` too; ``ok`` here keeps that
    meaning, and :func:`consumed_counts` reports both totals.
    """
    by_reason = standardized.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    kept = standardized.filter(F.col("reason") == "ok")
    copies = (
        kept.groupBy(identity)
        .agg(F.count(F.lit(1)).alias("c"))
        .agg((F.sum("c") - F.count(F.lit(1))).alias("n"))
        .filter(F.col("n") > 0)
        .select(F.lit("duplicate").alias("reason"), "n")
    )
    return by_reason.unionByName(copies)


def consumed_counts(reasons: DataFrame) -> DataFrame:
    """Records read, the legacy total that counts duplicates twice, and the kept rate."""
    dup = F.coalesce(F.sum(F.when(F.col("reason") == "duplicate", F.col("n"))), F.lit(0))
    ok = F.coalesce(F.sum(F.when(F.col("reason") == "ok", F.col("n"))), F.lit(0))
    total = F.sum("n")
    return reasons.agg(
        (total - dup).alias("consumed"),
        total.alias("consumed_legacy"),
        (ok / total).alias("kept_rate"),
    )


def exclude(items: DataFrame, blocked: DataFrame, on: str) -> DataFrame:
    """Items whose key is not in ``blocked``."""
    return items.join(blocked.select(on).distinct(), on, "left_anti")


def excluded(items: DataFrame, blocked: DataFrame, on: str) -> DataFrame:
    """The items :func:`exclude` removes."""
    return items.join(blocked.select(on).distinct(), on, "left_semi")


def group_split(
    df: DataFrame,
    group: str,
    valid_frac: float,
    test_frac: float,
    seed: str,
    *,
    out: str = "group_split",
) -> DataFrame:
    """Assign whole groups: fill test, then valid, the rest is train.

    A group goes to a part while the part is still short of its target, so the
    last group admitted may overshoot it.  Only the group table is ordered.
    """
    groups = (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__h", order_key(seed, F.coalesce(F.col(group), F.lit(""))))
    )
    placed = preceding_total(groups, "__h", group, "n", "before")
    n = row_count(df)
    test_target = F.floor(n * test_frac)
    valid_target = F.floor(n * valid_frac)
    targets = placed.withColumn("__tt", test_target).withColumn("__vt", valid_target)
    # Test ends at the first running total that reaches its target.
    in_test = F.col("before") < F.col("__tt")
    test_size = targets.filter(in_test).agg(
        F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0)).alias("s")
    )
    assigned = targets.withColumn("__ts", test_size.scalar()).select(
        F.col(group).alias("__g"),
        F.when(in_test, F.lit("test"))
        .when(F.col("before") - F.col("__ts") < F.col("__vt"), F.lit("valid"))
        .otherwise(F.lit("train"))
        .alias(out),
    )
    return df.join(assigned, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def size_histogram(df: DataFrame, size: str) -> DataFrame:
    """``size, n``; a null size counts as a failure to parse."""
    return df.groupBy(size).agg(F.count(F.lit(1)).alias("n"))


def cap_summary(hist: DataFrame, size: str, cap: int, scale: Column) -> DataFrame:
    """Share above a cap, the largest size, and the tail bands scaled to the whole."""
    n, s = F.col("n"), F.col(size)
    parsed = F.sum(F.when(s.isNotNull(), n))
    over = F.coalesce(F.sum(F.when(s > cap, n)), F.lit(0))
    bounds, lo = [], cap + 1
    for hi in TAIL_EDGES:
        bounds.append((f"{lo}-{hi}", lo, hi))
        lo = hi + 1
    bounds.append((f"{lo}+", lo, None))
    tail = [
        F.struct(
            F.lit(label).alias("band"),
            F.coalesce(
                F.sum(F.when((s >= a) if b is None else s.between(a, b), n)), F.lit(0)
            ).alias("n_sampled"),
        )
        for label, a, b in bounds
    ]
    summary = hist.agg(
        parsed.alias("parsed"),
        F.coalesce(F.sum(F.when(s.isNull(), n)), F.lit(0)).alias("failed"),
        over.alias("over_cap"),
        (over / parsed).alias("over_cap_share"),
        F.max(s).alias("largest_seen"),
        F.array(*tail).alias("tail"),
    ).withColumn("scale", scale)
    return summary.withColumn("implied_over_cap", F.bround(F.col("over_cap") * F.col("scale")))


def tail_bands(summary: DataFrame) -> DataFrame:
    return summary.select("scale", F.explode("tail").alias("t")).select(
        "t.band",
        "t.n_sampled",
        F.bround(F.col("t.n_sampled") * F.col("scale")).cast("long").alias("implied"),
    )


def long_enough(df: DataFrame, text: str, cap: int) -> DataFrame:
    """Cheap filter that loses nothing: a text of n units has at least n characters."""
    return df.filter(F.length(text) >= cap + 1)


def raised_cap_fates(
    df: DataFrame,
    base_rules: Sequence[tuple[str, Column]],
    raised_rules: Sequence[tuple[str, Column]],
    size: str,
    n_tokens: str,
    *,
    rejected_as: str = "too_large",
) -> DataFrame:
    """What happens to rows only one rule rejects once that rule is relaxed.

    ``fate, decade, n, longest_tokens``; ``decade`` is set for survivors only.
    """
    judged = (
        df.withColumn("__base", first_reason(base_rules))
        .filter(F.col("__base") == rejected_as)
        .withColumn("__raised", first_reason(raised_rules))
        .withColumn(
            "fate",
            F.when(F.col("__raised") == "ok", F.lit("survives")).otherwise(F.col("__raised")),
        )
        .withColumn(
            "decade",
            F.when(F.col("fate") == "survives", (F.floor(F.col(size) / 10) * 10).cast("int")),
        )
    )
    return judged.groupBy("fate", "decade").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("fate") == "survives", F.col(n_tokens))).alias("longest_tokens"),
    )


def size_between(df: DataFrame, size: str, lo: int | None, hi: int | None, need: int = 0):
    """Inclusive size filter, a bound of None not tested; a pool smaller than ``need`` is an error."""
    kept = df if lo is None else df.filter(F.col(size) >= lo)
    kept = kept if hi is None else kept.filter(F.col(size) <= hi)
    if not need:
        return kept
    return kept.withColumn("__n", row_count(kept)).withColumn(
        "__n",
        F.when(F.col("__n") >= need, F.col("__n")).otherwise(
            F.raise_error(F.lit(f"pool is smaller than {need}")).cast("long")
        ),
    ).filter(F.col("__n") >= 0).drop("__n")


def shard_meta(splits: DataFrame, group_splits: DataFrame, reasons: DataFrame) -> DataFrame:
    """``section, name, n`` rows of the shard summary."""
    parts = [
        splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("splits").alias("section"), F.col("split").alias("name"), "n"
        ),
        group_splits.groupBy("group_split").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("group_splits").alias("section"), F.col("group_split").alias("name"), "n"
        ),
        reasons.select(F.lit("drop_reasons").alias("section"), F.col("reason").alias("name"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_overlaps(df: DataFrame, item: str, split: str) -> DataFrame:
    """Items that sit in more than one split; a sound split returns no row."""
    return (
        df.groupBy(item)
        .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )
