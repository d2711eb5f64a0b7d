"""A multiway hyperplane tree over integer vectors, searched by inner product for blocks of queries.

A node has up to ``FAN`` split points; every row goes to the nearest.  For each pair of split point
and sibling subtree the node keeps the least and largest distance between them, and for each
subtree the least and largest squared norm of its rows.

A query looks for inner products between ``low`` and ``high``.  For rows whose squared norm lies in
a subtree's range this is an annulus of distances around the query; a subtree goes when its range
around any split point cannot meet the annulus by the triangle inequality.  What stays is compared
row by row in whole numbers, so results are exact whatever the tree looks like.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .vectors import LONG, largest

FAN = 12
LEAF = 256
#: Rounding of distances stays below this share of the norms involved.
SLACK = 1e-6


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * (x @ points.T) + (points * points).sum(1)
    return np.sqrt(np.maximum(square, 0))


def spread_points(candidates: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` different points, each the farthest from those before it."""
    chosen = [0]
    nearest = distances(candidates, candidates[:1])[:, 0]
    nearest[(candidates == candidates[0]).all(1)] = 0
    while len(chosen) < wanted and nearest.max() > 0:
        at = int(nearest.argmax())
        chosen.append(at)
        nearest = np.minimum(nearest, distances(candidates, candidates[at : at + 1])[:, 0])
        nearest[(candidates == candidates[at]).all(1)] = 0
    return candidates[chosen]


@dataclass
class Ranges:
    """Split points, their distance ranges to each sibling subtree, and norms within it."""

    points: np.ndarray
    near: np.ndarray
    far: np.ndarray
    least_norm: np.ndarray
    most_norm: np.ndarray

    def alive(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries by subtrees: whether a row there may have an inner product within the bounds."""
        norm = (q * q).sum(1)[:, None]
        slack = SLACK * (np.sqrt(norm) + np.sqrt(np.maximum(self.most_norm, 0)))
        outer = np.where(low == -LONG, np.inf, low.astype(float))[:, None]
        outer = norm + self.most_norm - 2 * np.where(np.isinf(outer), -np.inf, outer)
        inner = norm + self.least_norm - 2 * np.where(high == LONG, np.inf, high.astype(float))[:, None]
        reach = np.sqrt(np.maximum(outer, 0)) + slack
        hole = np.sqrt(np.maximum(inner, 0)) - slack
        out = (self.most_norm >= 0) & (outer >= -slack * slack)
        for at, near, far in zip(distances(q, self.points).T, self.near, self.far):
            at = at[:, None]
            out &= (near <= at + reach) & (far >= at - reach) & (far + at >= hole)
        return out


def ranges(x: np.ndarray, points: np.ndarray, child: np.ndarray, away: np.ndarray) -> Ranges:
    m = len(points)
    near, far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    least, most = np.full(m, np.inf), np.full(m, -1.0)
    norm = (x * x).sum(1)
    for j in range(m):
        own = child == j
        if own.any():
            near[:, j], far[:, j] = away[own].min(0), away[own].max(0)
            least[j], most[j] = norm[own].min(), norm[own].max()
    return Ranges(points, near, far, least, most)


@dataclass
class Node:
    rows: np.ndarray
    ranges: Ranges | None = None
    children: list[Node] = field(default_factory=list)


def build(x: np.ndarray, rows: np.ndarray) -> Node:
    """A tree over ``x[rows]``; rows of a leaf come in rising order."""
    if len(rows) <= LEAF:
        return Node(np.sort(rows))
    points = spread_points(x[rows[:: max(1, len(rows) // (4 * FAN))]], FAN)
    if len(points) < 2:
        points = spread_points(x[rows], FAN)
    if len(points) < 2:  # all rows are equal
        return Node(np.sort(rows))
    away = distances(x[rows], points)
    child = away.argmin(1)
    kept = [j for j in range(len(points)) if (child == j).any()]
    if len(kept) < 2:
        return Node(np.sort(rows))
    node = Node(rows[:0], ranges(x[rows], points, child, away))
    node.children = [build(x, rows[child == j]) for j in range(len(points))]
    return node


class Search:
    """The best ``k`` rows of each query and window: falling score, then rising id.

    ``same`` asks for rows of the query's label, else for rows of any other.  ``low`` and ``high``
    bound the scores of each window; ``low`` rises to the k-th best score found.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")  # so that rows of a leaf come by rising id
        self.x, self.ids, self.labels, self.rows, self.k = x[order], ids[order], labels[order], rows[order], k
        self.points = self.x.astype(float)
        self.root = build(self.points, np.arange(len(ids)))

    def run(
        self, q: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, by query, window and place; unused places have the score ``-LONG``."""
        self.q, self.floats, self.q_labels, self.q_rows, self.same = q, q.astype(float), labels, rows, same
        self.low, self.high = low.copy(), high
        shape = (*low.shape, self.k)
        self.scores, self.found = np.full(shape, -LONG), np.full(shape, LONG)
        bound = q.shape[1] * largest(q) * largest(self.x)
        self.exact = float if bound < 1 << 53 else np.int64 if bound <= LONG else object
        self._visit(self.root, np.arange(len(q)))
        return self.scores, self.found

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.ranges is None:
            for at in range(0, len(node.rows), LEAF):
                self._compare(node.rows[at : at + LEAF], who)
            return
        order = distances(self.floats[who], node.ranges.points).mean(0).argsort(kind="stable")
        for j in order:
            low, high = self._hull(who)
            alive = node.ranges.alive(self.floats[who], low, high)[:, j]
            self._visit(node.children[j], who[alive])

    def _hull(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.low[who].min(1), self.high[who].max(1)

    def _compare(self, rows: np.ndarray, who: np.ndarray) -> None:
        scores = self.q[who].astype(self.exact) @ self.x[rows].astype(self.exact).T
        if self.exact is object:
            scores = np.clip(scores, -LONG + 1, LONG).astype(np.int64)
        fits = (self.q_labels[who][:, None] == self.labels[rows]) == self.same
        if self.same:
            fits &= self.q_rows[who][:, None] != self.rows[rows]
        for w in range(self.low.shape[1]):
            hit = fits & (scores >= self.low[who, w][:, None]) & (scores <= self.high[who, w][:, None])
            r, c = np.nonzero(hit)
            if len(r):
                self._merge(who, w, r, scores[r, c].astype(np.int64), self.ids[rows[c]])

    def _merge(self, who: np.ndarray, w: int, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, r = np.unique(r, return_inverse=True)
        at = who[touched]
        old = np.repeat(np.arange(len(at)), self.k)
        r = np.r_[old, r]
        score, ids = np.r_[self.scores[at, w].ravel(), score], np.r_[self.found[at, w].ravel(), ids]
        order = np.lexsort((ids, -score, r))
        r, score, ids = r[order], score[order], ids[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < self.k
        self.scores[at[r[kept]], w, place[kept]] = score[kept]
        self.found[at[r[kept]], w, place[kept]] = ids[kept]
        self.low[at, w] = np.maximum(self.low[at, w], self.scores[at, w, -1])
