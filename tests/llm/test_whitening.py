"""Jacobi-Davidson against dense eigenvalues; the query against a dense covariance in exact sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.llm import whitening as W
from shortlist.llm import whitening_query


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


SPECTRA = {
    "flat": np.linspace(1, 2, 64),
    "clustered": np.r_[[5, 5 - 1e-7, 5 - 2e-7, 4.9], np.linspace(0, 4.8, 120)],
    "equal": np.r_[[3, 3, 3, 3, 3, 3], np.linspace(0, 2, 50)],
    "low rank": np.r_[[7, 2], np.zeros(30)],
    "steep": 10.0 ** -np.arange(20),
    "tiny": np.array([2.0]),
    "few": np.array([3.0, 2.0, 1.0]),
    "wide": np.random.default_rng(0).gamma(2, size=400),
    "large": 1e12 * np.linspace(1, 2, 40),
    "zero": np.zeros(12),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_jacobi_davidson_finds_the_largest(name):
    a = symmetric(SPECTRA[name], 5)
    jobs = []

    def product(u):
        jobs.append(u.shape)
        return a @ u

    values, vecs = W.jacobi_davidson(product, len(a), 4)
    true = np.sort(SPECTRA[name])[::-1][:4]
    scale = max(true[0], 1e-300)
    assert np.abs(values - true).max() <= 1e-12 * scale
    assert np.abs(vecs.T @ vecs - np.eye(len(true))).max() < 1e-12
    assert np.linalg.norm(a @ vecs - vecs * values, axis=0).max() <= 1e-11 * scale
    assert len(jobs) < 160 and all(m <= 16 for _, m in jobs)


def test_minres_solves_the_projected_system():
    rng = np.random.default_rng(3)
    a = symmetric(np.linspace(1, 2, 12), 1)
    q = W.orthonormal(rng.standard_normal((12, 2)))
    without = lambda z: z - q @ (q.T @ z)
    right, shift = rng.standard_normal((12, 3)), np.array([1.5, 1.7, 3.0])
    x = W.minres(lambda u: a @ u, without, right, shift, 14)
    assert np.abs(without(a @ x - x * shift) - without(right)).max() < 1e-8 and np.abs(q.T @ x).max() < 1e-12


def dense(vectors):
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    unique = sorted(set(x))
    n, sums = len(unique), [sum(c) for c in zip(*unique)]
    u = np.array(unique, float) - np.array(sums) / n
    e, z = np.linalg.eigh(u.T @ u / n)
    return x, n, sums, e[::-1], z[:, ::-1]


SCHEMA = "vec_id long, embedding array<float>, label int, component string, x string"


def run(spark, tmp_path, rows, name="t"):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return whitening_query.query(spark, folder).collect()


def test_query_against_the_dense_covariance(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 9)) * np.linspace(1, 3, 9) + 0.3).astype("float32").tolist()
    vectors += [vectors[0]] * 150 + [vectors[1]]  # a hot vector counts once
    bad = [None, [None] + [0.5] * 8, [float("nan")] * 9, [float("inf")] + [0.0] * 8]
    rows = [(i, v, 0, "clash", "clash") for i, v in enumerate(vectors + bad)] + [(None, vectors[2], None, "", "")]
    got = run(spark, tmp_path, rows)
    x, n, sums, e, z = dense(vectors)
    assert len(got) == 4 * (len(vectors) + 1) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    signs = {}
    for r in got:
        if r.vec_id is None:
            continue
        c = r.component - 1
        row = x[r.vec_id]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums))
        assert math.isclose(r.explained, e[c] / e.sum(), rel_tol=1e-10)
        want = (np.array(row) - np.array(sums) / n) @ z[:, c] / math.sqrt(e[c])
        signs.setdefault(c, math.copysign(1, want * r.whitened) if abs(want) > 1e-3 else 1)
        assert abs(want * signs[c] - r.whitened) < 1e-9


def test_repeated_rows_keep_their_rows_and_count_once(spark, tmp_path):
    rows = [(1, [0.5, 0.25], 0, "", ""), (1, [0.5, 0.25], 0, "", ""), (2, [0.0, 1.0], 0, "", ""), (3, [0.25, -1.0], 0, "", "")]
    got = run(spark, tmp_path, rows)
    assert len(got) == 8 and {r.n for r in got} == {3} and {r.component for r in got} == {1, 2}
    assert len({r.whitened for r in got if r.vec_id == 1 and r.component == 1}) == 1


def test_no_variance_no_component(spark, tmp_path):
    assert run(spark, tmp_path, [], "empty") == []
    assert run(spark, tmp_path, [(1, None, 0, "", "")], "null") == []
    assert run(spark, tmp_path, [(1, [1.0, 2.0], 0, "", ""), (2, [1.0, 2.0], 0, "", "")], "same") == []
    assert run(spark, tmp_path, [(1, [], 0, "", ""), (2, [], 0, "", "")], "none") == []
    line = [(i, [float(i), 2.0 * i, 1.0], 0, "", "") for i in range(6)]
    assert {r.component for r in run(spark, tmp_path, line, "line")} == {1}
    ragged = run(spark, tmp_path, [(1, [1.0], 0, "", ""), (2, [1.0, 0.5], 0, "", "")], "ragged")
    assert {(r.vec_id, r.deviation) for r in ragged} == {(1, 128 * 128), (2, 128 * 128)}


def test_numbers_beyond_a_long():
    x = np.array([[1 << 40, -(1 << 40)], [1 << 62, 0], [3, 4]])
    n, sums = 7, [5, -(1 << 50)]
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert W.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]
    assert W.deviations(x[2:], n, [5, 1]) == [(21 - 5) ** 2 + 27**2]


def test_totals_are_exact(spark):
    rows = spark.createDataFrame([([(1 << 62) + i, -i],) for i in range(9)], "x array<bigint>")
    blocks = W.packed_rows(rows, 2)
    assert W.totals(blocks, 2) == [9 * (1 << 62) + 36, -36]
    assert blocks.agg(F.sum("rows")).first()[0] == 9
