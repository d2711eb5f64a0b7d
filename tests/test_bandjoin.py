"""Band tables of any size against a test of every band."""

from __future__ import annotations

import random

import numpy as np
import pytest

from shortlist.operators import bandjoin


def test_tiles_cover_a_band_once():
    for n in range(1, 40):
        levels = bandjoin._levels(np.arange(n - 1))
        for first in range(n):
            for end in range(first, n + 1):
                nodes = bandjoin.tiles(first, end)
                assert len(nodes) <= 2 * (levels + 1)
                for i in range(n):
                    path = {(v << 32) + (i >> v) for v in range(levels + 1)}
                    assert len(path.intersection(nodes)) == (first <= i < end)


@pytest.mark.parametrize("seed", range(3))
def test_join_against_every_band(spark, seed):
    rng = random.Random(seed)
    bands = [(f"b{i}", *sorted(rng.randint(-30, 60) for _ in range(2))) for i in range(70)]
    bands += [("from", 20, None), ("to", None, 5), ("all", None, None), ("none", 9, 3), ("point", 7, 7), ("far", 2**62, None)]
    values = [rng.randint(-40, 70) for _ in range(200)] + [None, 2**62, -(2**62)] + [7] * 50
    bdf = spark.createDataFrame(bands, "band string, lo long, hi long")
    vdf = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id long, v long")
    holds = lambda x, lo, hi: (lo is None and hi is None) if x is None else (lo is None or x >= lo) and (hi is None or x <= hi)
    want = sorted((i, b) for i, x in enumerate(values) for b, lo, hi in bands if holds(x, lo, hi))
    got = sorted((r.id, r.band) for r in bandjoin.join_bands(vdf, "v", bdf).collect())
    assert got == want
    counted = {r.band: (r.n, r.id) for r in bandjoin.count_by_band(vdf, "v", bdf, "id").collect()}
    assert counted == {b: (len(m), sum(m)) for b, *_ in bands for m in [[i for i, c in want if c == b]]}


def test_empty_tables(spark):
    bands = spark.createDataFrame([], "band string, lo long, hi long")
    rows = spark.createDataFrame([(1,)], "v long")
    assert bandjoin.join_bands(rows, "v", bands).collect() == []
    some = spark.createDataFrame([("a", 1, 2)], "band string, lo long, hi long")
    assert bandjoin.join_bands(rows.limit(0), "v", some).collect() == []
    assert [tuple(r) for r in bandjoin.count_by_band(rows.limit(0), "v", some).collect()] == [("a", 1, 2, 0)]


def test_too_many_bounds(spark, monkeypatch):
    monkeypatch.setattr(bandjoin, "MOST_BOUNDS", 3)
    with pytest.raises(ValueError, match="bounds"):
        bandjoin.bounds_of(spark.createDataFrame([(1, 2), (5, 9)], "lo long, hi long"))
