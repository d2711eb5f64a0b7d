"""Near copies by exact Jaccard similarity of word shingles; SimHash and min-hash bands find the candidates.

A text is the set of its runs of ``WORDS`` words (ASCII lower case).  Two texts are linked if
their sets' Jaccard similarity is ``LIMIT`` or more, computed on the whole sets.  Candidates come
from two indexes.  First, texts whose 64-bit SimHash prints of the same shingles are equal or
linked in the index of :mod:`simhash` (spanning links, not all pairs).  A radius of a few bits
misses most edited copies at 0.8, so candidates are also
texts that share one of ``BANDS`` keys made of ``ROWS`` min-hashes each: at a similarity of 0.8
a pair shares none in 0.02 % of cases, above it more rarely.

All pairs of a bucket with up to ``SMALL`` texts are compared.  In a larger one, every text is
first compared with two texts of the bucket (by hash), components are named, and buckets with
more than one component go on with two others, ``ROUNDS`` times at least and as long as links
are found: groups of copies, however large, become one component in time linear in their size.
Where a bucket still has several, its texts are cut into blocks, a large component into blocks of
its own, and every two blocks meet in a task of their own unless they are of one component: all
pairs across components are compared, none is emitted but the links.  This last step alone
grows with the square of a bucket, and only for texts that share a band without being copies.

Texts with the same words are one node; null and empty texts have no words and are one too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import simhash
from .components import components

WORDS = 5
LIMIT = 0.8
BANDS = 16
ROWS = 4
SMALL = 32
ROUNDS = 3
#: Texts of a block on average; a task holds two blocks.
BLOCK = 128
SEED = 42

_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_PART = 1 << 12


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted XXH64 of the distinct runs of words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    runs = {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}
    return np.unique(np.fromiter((xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs)))


def sketch(text: str | None) -> tuple[int, list[int]]:
    """Hash of the words, and the band keys."""
    from xxhash import xxh64_intdigest

    words = _words(text)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    found = shingles(words)
    for at in range(0, len(found), _PART):
        least = np.minimum(least, (found[at : at + _PART, None] * _FACTORS).min(axis=0))
    keys = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    every = np.array([xxh64_intdigest(b" ".join(words), SEED), *keys], np.uint64).view(np.int64).tolist()
    return every[0], every[1:]


def sketches(text: Column) -> Column:
    @F.pandas_udf("struct<fp:long,bands:array<long>,print:long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(*sketch(t), simhash.fingerprint(t, WORDS)) for t in texts]
        return pd.DataFrame(rows, columns=["fp", "bands", "print"])

    return of(text)


@lru_cache(maxsize=256)
def _set(text: str | None) -> np.ndarray:
    return shingles(_words(text))


def jaccard(a: str | None, b: str | None) -> float:
    x, y = _set(a), _set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose texts (``fp``, ``t``) are similar."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(a, b) >= LIMIT for a, b in zip(x, y)], dtype=bool)

    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(pairs.join(left, "a").join(right, "b").where(similar("ta", "tb")).select("a", "b"), "near-links")


def print_pairs(sketched: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` by SimHash: texts of one print with its first, and firsts of linked prints."""
    firsts = materialize(sketched.groupBy("print").agg(F.min("fp").alias("first")), "near-firsts")
    alike = sketched.join(firsts, "print").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    links = simhash.links(simhash.upper_nodes(firsts.select(F.col("print").alias("fp"))))
    ends = links.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b")
    return materialize(alike.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "near-pairs")


def labels(sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """``node`` and ``label`` for every linked text; ``sketched`` has ``fp``, ``bands``, ``print``, a row each.

    ``texts`` has ``fp``, ``t`` and may repeat; only texts of candidates are stored again.
    """
    by_print = print_pairs(sketched)
    rows = materialize(sketched.select("fp", F.explode("bands").alias("bucket")), "near-bands")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(rows.join(sizes, "bucket"), "near-members")
    wanted = members.select("fp").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    texts = materialize(texts.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("t").alias("t")), "near-texts")
    groups = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list("fp").alias("m"))
    pairs = groups.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).where("a < b")
    edges = _linked(by_print.unionByName(pairs), texts)
    named = components(edges)
    large = members.where(F.col("n") > SMALL).select("bucket", "fp")
    if not large.take(1):
        return named
    again, k = True, 0
    while again or k < ROUNDS:
        own = large.join(named, large.fp == named.node, "left").select("bucket", "fp", F.coalesce("label", "fp").alias("label"))
        own = materialize(own, "near-large")
        one = F.struct(F.xxhash64(F.lit(k), "fp").alias("h"), "fp", "label")
        mixed = own.groupBy("bucket").agg(
            F.min(one).alias("low"), F.max(one).alias("high"), F.min("label").alias("x"), F.max("label").alias("y")
        )
        heads = mixed.where("x <> y").select("bucket", F.explode(F.array("low", "high")).alias("head"))
        heads = heads.select("bucket", F.col("head.fp").alias("b"), F.col("head.label").alias("other"))
        pairs = own.join(heads, "bucket").where("label <> other").select(F.col("fp").alias("a"), "b")
        new = _linked(pairs, texts)
        again = bool(new.take(1))
        if again:
            edges = edges.unionByName(new)
            named = components(edges)
        k += 1
    own = large.join(named, large.fp == named.node, "left").select("bucket", "fp", F.coalesce("label", "fp").alias("label"))
    new = _across(materialize(own, "near-large"), texts)
    return components(edges.unionByName(new)) if new.take(1) else named


def _across(own: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts of one bucket but different labels; ``own`` has ``bucket``, ``fp``, ``label``."""
    sizes = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("labels"), F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).alias("mixed")
    )
    sizes = sizes.join(buckets.where("labels > 1"), "bucket")
    lone = F.col("n") >= BLOCK
    salt = lambda n: F.pmod(F.xxhash64("fp"), F.ceil(n / BLOCK))
    block = F.when(lone, F.struct(F.lit(1).alias("lone"), F.col("label").alias("of"), salt(F.col("n")).alias("part")))
    block = block.otherwise(F.struct(F.lit(0).alias("lone"), F.lit(0).cast("long").alias("of"), salt(F.col("mixed")).alias("part")))
    members = materialize(own.join(sizes, ["bucket", "label"]).select("bucket", "fp", "label", block.alias("x")), "near-blocks")
    blocks = members.select("bucket", "x").distinct()
    of_one = (F.col("x.lone") == 1) & (F.col("y.lone") == 1) & (F.col("x.of") == F.col("y.of"))
    meets = blocks.join(blocks.withColumnRenamed("x", "y"), "bucket").where(F.col("x") <= F.col("y")).where(~of_one)
    meets = materialize(meets.select("bucket", "x", "y", F.expr("uuid()").alias("meet")), "near-meets")
    here = meets.select("bucket", "x", "meet", F.lit(0).alias("side"))
    there = meets.where(F.col("x") != F.col("y")).select("bucket", F.col("y").alias("x"), "meet", F.lit(1).alias("side"))
    seated = members.join(here.unionByName(there), ["bucket", "x"]).join(texts, "fp").select("meet", "side", "fp", "label", "t")
    return materialize(seated.groupBy("meet").applyInPandas(_meeting, "a long, b long").distinct(), "near-links")


def _meeting(group: pd.DataFrame) -> pd.DataFrame:
    """Links ``a`` < ``b`` between the texts of two blocks, or inside the only one, with different labels."""
    group = group.sort_values(["side", "fp"], ignore_index=True)
    fp, label, side = (group[c].to_numpy() for c in ("fp", "label", "side"))
    sets = [shingles(_words(t)) for t in group["t"]]
    size = np.array([len(s) for s in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner, start = np.repeat(np.arange(len(sets)), size), np.r_[0, np.cumsum(size)]
    has = np.zeros(int(number.max(initial=-1)) + 1, bool)
    out = []
    two = bool(side.any())
    for i in np.flatnonzero(side == 0):
        mine = number[start[i] : start[i + 1]]
        has[mine] = True
        both = np.bincount(owner[has[number]], minlength=len(sets))
        has[mine] = False
        near = (both >= LIMIT * (size[i] + size - both)) & (label != label[i])
        near &= side == 1 if two else np.arange(len(sets)) > i
        out += [(min(fp[i], fp[j]), max(fp[i], fp[j])) for j in np.flatnonzero(near)]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
