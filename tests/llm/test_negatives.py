"""The tree search and the query against brute force over all pairs, and against the SQL twin."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from shortlist.llm import gnat, negatives, negatives_query
from shortlist.llm.vectors import LONG


def best(scored, k):
    return sorted(scored, key=lambda s: (-s[0], s[1]))[:k]


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "large", "huge"])
def test_search_against_brute_force(kind):
    rng = np.random.default_rng(7)
    n, d = 1500, 6
    x = rng.integers(-40, 40, (n, d))
    if kind == "clustered":
        x = rng.integers(-200, 200, (12, d))[rng.integers(0, 12, n)] + rng.integers(-2, 3, (n, d))
    if kind == "equal":
        x[200:] = x[0]
    if kind == "large":
        x = x * (1 << 22)
    if kind == "huge":
        x = x * (1 << 25)
    ids, labels, rows = rng.permutation(n) // 2, rng.integers(0, 3, n), np.arange(n)
    tree = gnat.Search(x, ids, labels, rows, 5)
    q = np.arange(0, n, 50)
    scale = min(int(np.abs(x).max()) ** 2 + 1, LONG // (2 * d))
    low = rng.integers(-d * scale, d * scale // 2, (len(q), 3))
    high = low + rng.integers(0, d * scale // 2, (len(q), 3))
    low[::3], high[1::3] = -LONG, LONG
    exact = [[int(a) for a in row] for row in x]
    for same in (True, False):
        scores, found = tree.run(x[q], labels[q], q, low, high, same)
        for i, a in enumerate(q):
            all_scores = [max(1 - LONG, min(LONG, sum(s * t for s, t in zip(exact[a], row)))) for row in exact]
            for w in range(3):
                rows_ = [b for b in range(n) if (labels[b] == labels[a]) == same and (b != a or not same)]
                want = best([(all_scores[b], int(ids[b])) for b in rows_ if low[i, w] <= all_scores[b] <= high[i, w]], 5)
                got = [(int(s), int(b)) for s, b in zip(scores[i, w], found[i, w]) if s > -LONG]
                assert got == want


def test_ranges_rule_out_far_subtrees():
    rng = np.random.default_rng(1)
    x = (rng.integers(-300, 300, (40, 8))[rng.integers(0, 40, 20000)] + rng.integers(-3, 4, (20000, 8))).astype(float)
    points = gnat.spread_points(x[:400], 12)
    away = gnat.distances(x, points)
    child = away.argmin(1)
    r = gnat.ranges(x, points, child, away)
    q = x[::500]
    scores = q @ x.T
    low = np.sort(scores, 1)[:, -20].astype(np.int64)
    alive = r.alive(q, low, np.full(len(q), LONG))
    for i in range(len(q)):
        assert alive[i, np.unique(child[scores[i] >= low[i]])].all()
    assert alive.mean() < 0.5


def brute(rows):
    kept = []
    for i, (v, e, label) in enumerate(r[:3] for r in rows):
        if v is None or label is None or e is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        kept.append((i, v, (label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in e]))
    out = Counter()
    for i, v, label, x in kept:
        if v % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), w, m) for j, w, m, y in kept if j != i]
        for p, pid in best([(s, w) for s, w, m in scored if m == label], 5):
            window = [(s, w) for s, w, m in scored if m != label and 80 * p <= 100 * s <= 100 * p]
            for rank, (s, w) in enumerate(best(window, 5), 1):
                out[v, pid, rank, w, p, s] += 1
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell int, x int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def run(spark, tmp_path, rows, name="t"):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return Counter(tuple(r[c] for c in COLUMNS) for r in negatives_query.query(spark, folder).collect())


def made(n, seed, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((15, d))
    v = (centres[rng.integers(0, 15, n)] + 0.2 * rng.standard_normal((n, d))).astype("float32")
    return [(int(i), v[i].tolist(), int(rng.integers(0, 10)), "clash", 0, 0) for i in range(n)]


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 60)  # many cells, chunks and blocks
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(gnat, "LEAF", 8)
    rows = made(1200, 4)
    rows += [(5000 + i, rows[100][1], i % 3, "hot", 0, 0) for i in range(400)]  # one vector holds a quarter
    rows += [(5600, None, 1, "", 0, 0), (5700, [float("nan")] * 6, 1, "", 0, 0), (5800, [None] * 6, 1, "", 0, 0)]
    rows += [(5900, [1.0] * 6, None, "", 0, 0), (None, [1.0] * 6, 1, "", 0, 0), (6000, [float("inf")] * 6, 1, "", 0, 0)]
    rows += [rows[200]] * 3 + [rows[100]]  # repeated anchors are each other's positives
    want = brute(rows)
    assert len(want) > 200 and run(spark, tmp_path, rows) == want


def test_few_rows_and_odd_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], "empty") == Counter()
    assert run(spark, tmp_path, [(0, None, 1, "", 0, 0)], "null") == Counter()
    lone = [(0, [1.0, 0.0], 1, "", 0, 0), (1, [1.0, 0.1], 3, "", 0, 0)]
    assert run(spark, tmp_path, lone, "lone") == Counter()
    below = [(100, [1.0, 0.0], 1, "", 0, 0), (1, [-1.0, 0.1], 1, "", 0, 0), (2, [-0.9, 0.0], 3, "", 0, 0)]
    assert run(spark, tmp_path, below, "below") == brute(below) == Counter()
    ragged = [(100, [1.0, 0.5], 1, "", 0, 0), (1, [1.0], 1, "", 0, 0), (2, [0.9, 0.0], 3, "", 0, 0), (3, [0.0, 0.0], 4, "", 0, 0)]
    filled = [(v, (e + [0.0])[:2], label, *rest) for v, e, label, *rest in ragged]
    assert run(spark, tmp_path, ragged, "ragged") == brute(filled) != Counter()


def test_sql_twin(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = made(700, 9, 5)
    got = run(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/t/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({negatives_query.SQL})").fetchall()
    assert got == Counter(want) == brute(rows)
