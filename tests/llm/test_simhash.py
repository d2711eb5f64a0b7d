"""SimHash classes against brute force over all pairs."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from shortlist.llm import simhash


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, bits=2):
    """Component (as smallest index) of each fingerprint."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints(spark):
    texts = ["The the THE the", "", None, " \t\n", "one", "A b", "É é É", "x y z " * 5000, "a b c d", "\x0bq w e r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = [r.f for r in df.orderBy("id").select(simhash.hex16(simhash.fingerprints(F.col("text"))).alias("f")).collect()]
    assert got == [f"{brute_print(t):016x}" for t in texts]


def test_classes_with_split_nodes(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for b in base[:25]:  # chains and clouds around some
        x = b
        for _ in range(rng.randint(1, 12)):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            fps.append(x)
            fps.append(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps += [base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]  # one dense cloud
    fps += [0, 0, 2**64 - 1, base[3]]
    want = brute_classes(fps)
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    for node_max in (simhash.NODE_MAX, 20):
        got = df.join(simhash.classes(df, node_max=node_max), "fp").select("id", "component_id").collect()
        assert {r.id: r.component_id for r in got} == dict(enumerate(want))


def test_gray_search_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 2**14, 900).astype(np.uint64))
    node = np.zeros(len(fp), np.int64)
    a, b = simhash._pairs_near(fp, node, 2)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert got == want


def test_edge_rows(spark):
    rows = [(None, 5), (None, 5), (7, 5), (7, 5), (None, -1), (3, 2**62)]
    df = spark.createDataFrame(rows, "id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(df).collect()}
    assert got == {5: 7, -1: None, 2**62: 3}
    assert simhash.classes(df.limit(0)).collect() == []


def test_gray_rank_orders_neighbours(spark):
    codes = [i ^ (i >> 1) for i in range(64)]
    df = spark.createDataFrame([(c,) for c in codes], "fp long").orderBy(simhash.gray_rank(F.col("fp")))
    assert [r.fp for r in df.collect()] == codes
