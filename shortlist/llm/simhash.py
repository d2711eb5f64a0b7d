"""SimHash fingerprints and their links within a few bits, found in a Gray-order hierarchical index.

The index is a forest of nodes.  An upper node stands for the fingerprints that share a masked
bit pattern: the 64 bits fall into ``max_bits + 1`` blocks, and two fingerprints that differ in
at most ``max_bits`` bits agree in one block at least, so they meet in a node.  A node with
more than ``node_max`` fingerprints is factored again over the bits it leaves free; its children
share a longer pattern.  Free bits run out before a node can stay large: one with ``f`` free
bits has at most 2**f members.

Inside a node the fingerprints lie in Gray-rank order, which puts those that share leading
bits, and differ in few others, side by side.  Runs of ``FAN`` neighbours form the lower nodes,
runs of those the next level, each with the bits that all its members share.  Two lower nodes
are compared by the differences in bits that both share; if these alone exceed the limit, all
pairs below are pruned.

Only distinct fingerprints enter the index, so copies cost one row.  A node gives a spanning
forest of its links, never all pairs, and components follow by contraction.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; equal
fingerprints are linked; rows may repeat; null ids belong to their component but do not name
it (a component of null ids only has a null name); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
NODE_MAX = 1024
FAN = 16
SEED = 42


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit majority vote over XXH64 of all word shingles of the ASCII-lower-cased text."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        votes = np.array([digest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(w) - words + 1].tolist()
        votes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(votes), 1 << 16):
        part = votes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(votes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in Gray order, shifted so that signed order is right."""
    r = fp
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(2**63)))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that deal the set bits of ``free`` into ``parts`` runs."""
    bits = [i for i in range(63, -1, -1) if free >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def upper_nodes(fps: DataFrame, max_bits: int = MAX_BITS, node_max: int = NODE_MAX) -> DataFrame:
    """``mask``, ``pattern``, ``fp``: members of every node with two to ``node_max`` fingerprints."""
    masks = [0]
    level = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    done = None
    while True:
        finer = {m: [m | b for b in _blocks(~m & (2**64 - 1), max_bits + 1)] for m in masks}
        choices = F.create_map(
            *[x for m, c in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in c]))]
        )
        level = level.select("fp", F.explode(choices[F.col("mask")]).alias("mask"))
        level = materialize(level.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-level")
        sizes = materialize(level.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
        sized = level.join(sizes, ["mask", "pattern"])
        small = sized.where(F.col("n") <= node_max).select("mask", "pattern", "fp")
        done = small if done is None else done.unionByName(small)
        masks = [y for c in finer.values() for y in c]
        if not sizes.where(F.col("n") > node_max).take(1) or all(m == 2**64 - 1 for m in masks):
            return done
        # a pattern may recur under several parents; a fingerprint enters each node once
        level = sized.where(F.col("n") > node_max).select("fp", "mask").distinct()


def _pairs_near(fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within ``max_bits`` bits; ``fp`` in Gray order inside runs of equal ``node``."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[first, len(node)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(size <= FAN, size)
    for k in range(1, FAN):  # small nodes: neighbours at each distance, all nodes at once
        i = np.flatnonzero((node[:-k] == node[k:]) & small[k:]) if len(node) > k else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= max_bits]
        found.append((i, i + k))
    for at, n in zip(first[size > FAN], size[size > FAN]):
        found.extend((a + at, b + at) for a, b in _search(fp[at : at + n], max_bits))
    return tuple(np.concatenate(x) for x in zip(*found))


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bits set in all and in any member of each node, from the leaves up."""
    levels = [(fp, fp)]
    while len(levels[-1][0]) > FAN:
        starts = np.arange(0, len(levels[-1][0]), FAN)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], starts), np.bitwise_or.reduceat(levels[-1][1], starts)))
    return levels


def _search(fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one node, top level down; a pair of lower nodes survives while its certain differences do."""
    levels = _levels(fp)
    top = len(levels[-1][0])
    stack = [(len(levels) - 1, *np.triu_indices(top))]
    while stack:
        depth, a, b = stack.pop()
        every, some = levels[depth]
        sure = (every[a] & ~some[b]) | (every[b] & ~some[a])  # set in all of one, in none of the other
        keep = np.bitwise_count(sure) <= max_bits
        a, b = a[keep], b[keep]
        if depth == 0:
            yield a[a < b], b[a < b]
            continue
        width, step = len(levels[depth - 1][0]), 1 << 12
        offset = np.arange(FAN)
        for at in range(0, len(a), step):
            x = (a[at : at + step, None, None] * FAN + offset[None, :, None]) + 0 * offset[None, None, :]
            y = (b[at : at + step, None, None] * FAN + offset[None, None, :]) + 0 * offset[None, :, None]
            fit = (x < width) & (y < width) & (x <= y)
            stack.append((depth - 1, x[fit], y[fit]))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` that span the links inside every node."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def spanned(part: pd.DataFrame) -> pd.DataFrame:
            fp = part["fp"].to_numpy().view(np.uint64)
            key = part[["mask", "pattern"]].to_numpy()
            node = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
            label = _forest(len(fp), *_pairs_near(fp, node, max_bits))
            own = np.flatnonzero(label != np.arange(len(fp)))
            return pd.DataFrame({"a": fp[own].view(np.int64), "b": fp[label[own]].view(np.int64)})

        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (part["mask"] == part["mask"].iloc[-1]) & (part["pattern"] == part["pattern"].iloc[-1])
            rest = part[last].reset_index(drop=True)  # the node may go on; it has node_max rows at most
            if (~last).any():
                yield spanned(part[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield spanned(rest)

    placed = (
        nodes.repartition(F.col("mask"), F.col("pattern"))
        .withColumn("rank", gray_rank(F.col("fp")))
        .sortWithinPartitions("mask", "pattern", "rank")
        .select("mask", "pattern", "fp")
    )
    return placed.mapInPandas(scan, "a long, b long")


def labelled(prints: DataFrame, max_bits: int = MAX_BITS, node_max: int = NODE_MAX) -> DataFrame:
    """``fp``, its smallest id ``least`` and the ``label`` of its class, for a table of ``id``, ``fp``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    edges = links(upper_nodes(distinct.select("fp"), max_bits, node_max), max_bits)
    labels = components(edges)
    return materialize(
        distinct.join(labels, distinct.fp == labels.node, "left").select(
            "fp", "least", F.coalesce("label", "fp").alias("label")
        ),
        "simhash-labels",
    )


def classes(prints: DataFrame, max_bits: int = MAX_BITS, node_max: int = NODE_MAX) -> DataFrame:
    """``fp`` and ``component_id``: the smallest id reachable over links."""
    named = labelled(prints, max_bits, node_max)
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-classes")
    return materialize(named.join(least, "label").select("fp", "component_id"), "simhash-named")
