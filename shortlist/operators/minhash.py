"""Approximate top-k by set similarity: banded min-hashes propose, exact similarities decide.

A set's signature is ``BANDS`` bands of ``ROWS`` min-hashes; sets that agree on a whole band share
a bucket.  A pair of similarity s shares none with probability ``(1 - s**ROWS) ** BANDS``: about
one in 1,000 at 0.6, one in 20 at 0.5.  Whatever is proposed is compared exactly, so a list holds
no wrong similarity and can only lack a set.

Queries within some passes of the scan go to every task, where they meet the sets that share a band
with one of them (``near_scan``).  More of them meet over shuffled buckets (``near_sets``):
small buckets are joined and their pairs compared in the row.  A bucket of more than ``SMALL``
index sets (a template, a hot group of near copies) is never paired out: its members meet in chunks
and blocks, as in the exact search, and only lists of k leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import tanimoto_sets
from ..session import materialize
from . import similar

BANDS, ROWS = 48, 4
SMALL = 64
SEED = 11


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _keys(flat: np.ndarray, sizes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of band keys per set; the elements lie one set after the other."""
    seeds = np.random.default_rng(SEED).integers(1, 2**63, bands * rows, dtype=np.uint64)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    least = np.zeros((len(some), bands, rows), np.uint64)
    base = _mixed(flat.astype(np.int64).view(np.uint64))
    if len(some):
        for j, seed in enumerate(seeds):
            least[:, j // rows, j % rows] = np.minimum.reduceat(_mixed(base ^ seed), starts)
    keys = np.zeros((len(sizes), bands), np.uint64)
    for r in range(rows):
        keys[some] = _mixed(keys[some] ^ least[:, :, r]) + np.uint64(r + 1)
    return keys.view(np.int64)


def band_keys(bits: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One 64-bit key per band of a set's min-hashes; an empty set has a key of its own."""

    @F.pandas_udf("array<bigint>")
    def of(sets: pd.Series) -> pd.Series:
        sizes = np.array([len(s) for s in sets], np.int64)
        return pd.Series(list(_keys(np.concatenate([np.zeros(0, np.int64), *sets]), sizes, bands, rows)))

    return of(bits)


def _buckets(sets: DataFrame, key: str) -> DataFrame:
    return sets.select(key, F.posexplode("bands").alias("band", "bucket"))


def near_scan(queries: DataFrame, sets: DataFrame, k: int, least: float, passes: int = 1) -> DataFrame:
    """Like :func:`near_sets`, for queries that go to every task: the index stays in place.

    A task compares the sets of a batch that share a band with one of its queries.
    """

    def proposed(batch: pa.RecordBatch, local: pa.Table) -> np.ndarray:
        # a task looks its queries' bands up once; ``local`` is the same object for all its batches
        if asked.get("of") is not local:
            asked.update(of=local, bands=[np.unique(b) for b in _of_lists(local.column("bands")).T])
        keys = _of_lists(batch.column("bands"))
        return np.any([np.isin(keys[:, i], b) for i, b in enumerate(asked["bands"])], axis=0)

    asked: dict = {}
    # both sides are hashed once, whatever the number of passes
    queries = materialize(queries.withColumn("bands", band_keys(F.col("bits"))), "near-asked")
    sets = materialize(sets.withColumn("bands", band_keys(F.col("bits"))), "near-index")
    return similar.scan_sets(queries, sets, k, least=least, passes=passes, proposed=proposed, also=("bands",))


def _of_lists(bands: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return similar._list(bands).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)


def near_sets(queries: DataFrame, sets: DataFrame, k: int, least: float) -> DataFrame:
    """Up to k sets of similarity ``least`` or more per query; both sides as distinct sets."""
    of = lambda df, key: df.withColumn("bands", band_keys(F.col("bits"))).withColumnRenamed("set_key", key)
    index = materialize(of(sets.withColumn("first_pos", F.col("first_pos").cast("long")), "set_key"), "near-index")
    asked = materialize(of(queries.select("set_key", "bits"), "q_key"), "near-asked")
    members, wanted = _buckets(index, "set_key"), _buckets(asked, "q_key")
    sizes = materialize(members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")), "near-sizes")

    small = members.join(sizes.filter(F.col("size") <= SMALL), ["band", "bucket"])
    pairs = small.join(wanted, ["band", "bucket"]).select("q_key", "set_key").distinct()
    compared = (
        pairs.join(asked.select("q_key", F.col("bits").alias("q_bits")), "q_key")
        .join(index.select("set_key", "first_pos", "bits"), "set_key")
        .select("q_key", "set_key", tanimoto_sets(F.col("q_bits"), F.col("bits")).alias("similarity"), "first_pos")
        .filter(F.col("similarity") >= least)
    )

    # Parts of a large bucket; a query meets every part of its bucket, in blocks.
    large = sizes.filter(F.col("size") > SMALL).withColumn("parts", F.ceil(F.col("size") / similar.CHUNK))
    part = lambda p: F.xxhash64("band", "bucket", p)
    held = (
        members.join(large, ["band", "bucket"])
        .withColumn("chunk", part(F.pmod(F.xxhash64("set_key"), "parts")))
        .join(index.select("set_key", "first_pos", "bits"), "set_key")
        .select("chunk", "set_key", "first_pos", "bits")
    )
    askers = wanted.join(large, ["band", "bucket"])
    blocks = askers.groupBy("band", "bucket").agg(F.ceil(F.count(F.lit(1)) / similar.BLOCK).alias("blocks"))
    met = (
        askers.join(blocks, ["band", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("q_key"), "blocks").cast("int"))
        .withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("chunk", part(F.col("p")))
        .join(asked.select("q_key", F.col("bits").alias("q_bits")), "q_key")
        .select("q_key", "q_bits", "chunk", "block", F.lit(float(least)).alias("floor"))
    )
    lists = similar.met(met, held, k).drop("chunk")
    return similar.best_of(compared.unionByName(lists).distinct(), k)
