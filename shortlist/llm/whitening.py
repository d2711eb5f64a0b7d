"""Whitening of embeddings along the leading components of their covariance, by Jacobi-Davidson.

The covariance V of the fit list is never formed: a block of vectors U meets it as the sum over
rows of ``(x - mean) ((x - mean) U)``, one Spark job over packed rows per block.  The driver holds
blocks of ``d`` numbers a column, never rows.

* **Rayleigh-Ritz.**  V is projected on an orthonormal search space W; the Ritz pairs of the
  largest values are the targets, ``GUARD`` of them beyond the wanted ones, so that a component
  that shows up late still comes before the last wanted one is locked.
* **Correction.**  For each target (theta, u) with residual r a few steps of MINRES solve
  ``(I - Q Q')(V - theta)(I - Q Q') t = -r``, Q being locked vectors and targets.  All targets step
  together, so a step is one job.  The solutions, made orthogonal to all there is, widen W.
* **Locking.**  A leading pair whose residual is down to rounding is locked: it leaves W, and
  everything later is kept orthogonal to it.  At ``MOST`` columns W is cut back to its best half.
* **End.**  All wanted pairs are locked, and one product with them confirms their residuals.

Defined cases: rows with a null vector or a null or non-finite entry do not take part; vectors
shorter than the longest are filled up with zeros; repeated vectors count once in the fit list,
while every row gets its own result; components of no variance (beyond the rank of V, or when all
vectors are equal) are left out; an empty table gives no rows; ``deviation`` is null where a long
cannot hold it.  Components of equal variance are any orthonormal basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import vectors
from .vectors import LONG, largest, matrix, pack, unpack

COMPONENTS = 4
GUARD = 4
#: Inner steps per correction, columns of the search space, and outer steps before giving up.
INNER, MOST, OUTER = 4, 48, 400
#: A residual counts as rounding below so many units per dimension, relative to the largest value.
UNITS = 4
#: Rows of one packed block.
BLOCK = 2048
SEED = 13

EPS = float(np.finfo(float).eps)
Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


# --- the eigenvalue problem, given products ---------------------------------------------------


def orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``t`` made orthonormal to ``bases`` and to each other; dependent ones go."""
    kept = np.zeros((t.shape[0], 0))
    for column in t.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            if size <= 0 or not np.isfinite(size):
                break
            column = column / size
            for basis in (*bases, kept):
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:  # nothing but rounding is left of it
                size = 0.0
        if size > 0:
            kept = np.c_[kept, column / np.linalg.norm(column)]
    return kept


def minres(product: Product, without: Product, right: np.ndarray, shifts: np.ndarray, steps: int) -> np.ndarray:
    """Least-residual solutions of the projected, shifted systems, one per column of ``right``."""
    v = without(right)
    size = np.linalg.norm(v, axis=0)
    rest = size.copy()
    v = v / np.where(size > 0, size, 1)
    zero = np.zeros_like(size)
    before, off = np.zeros_like(v), zero
    dirs = [np.zeros_like(v), np.zeros_like(v)]
    rotations = [(np.ones_like(size), zero), (np.ones_like(size), zero)]  # cosine and sine, the last two
    x = np.zeros_like(v)
    for _ in range(steps):
        w = without(product(v) - v * shifts)
        diagonal = (v * w).sum(0)
        w = w - v * diagonal - before * off
        below = np.linalg.norm(w, axis=0)
        (c0, s0), (c1, s1) = rotations
        far, top = s0 * off, c0 * off
        near, corner = c1 * top + s1 * diagonal, c1 * diagonal - s1 * top
        pivot = np.maximum(np.hypot(corner, below), np.finfo(float).tiny)
        c2, s2 = corner / pivot, below / pivot
        new = (v - dirs[0] * far - dirs[1] * near) / pivot
        x = x + new * (c2 * rest)
        rest = -s2 * rest
        dirs, rotations = [dirs[1], new], [(c1, s1), (c2, s2)]
        before, v, off = v, w / np.where(below > 0, below, 1), below
    return without(x)


def jacobi_davidson(product: Product, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors in columns."""
    wanted = min(wanted, d)
    space = orthonormal(np.random.default_rng(SEED).standard_normal((d, min(d, 2 * (wanted + GUARD)))))
    image = product(space)
    locked, scale = np.zeros((d, 0)), 0.0
    for _ in range(OUTER):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        scale = max(scale, float(np.abs(theta).max(initial=0.0)))
        targets = min(wanted - locked.shape[1] + GUARD, len(theta))
        if space.shape[1] + targets > max(MOST, 2 * targets):
            y = y[:, : max(MOST // 2, targets)]
        space, image, theta = space @ y, image @ y, theta[: y.shape[1]]
        residual = image[:, :targets] - space[:, :targets] * theta[:targets]
        done = np.linalg.norm(residual, axis=0) <= UNITS * d * EPS * scale
        leading = int(np.argmin(done)) if not done.all() else targets
        lock = min(leading, wanted - locked.shape[1])
        if lock:
            locked, space, image = np.c_[locked, space[:, :lock]], space[:, lock:], image[:, lock:]
            residual, theta, done, targets = residual[:, lock:], theta[lock:], done[lock:], targets - lock
        if locked.shape[1] == wanted:
            seen = product(locked)
            h = locked.T @ seen
            theta, y = np.linalg.eigh((h + h.T) / 2)
            theta, y = theta[::-1], y[:, ::-1]
            locked, seen = locked @ y, seen @ y
            if (np.linalg.norm(seen - locked * theta, axis=0) <= 2 * UNITS * d * EPS * scale).all():
                return theta, locked
            space, image, locked = np.c_[locked, space], np.c_[seen, image], np.zeros((d, 0))
            continue
        todo = np.flatnonzero(~done[:targets])
        fixed = np.c_[locked, space[:, :targets]]
        without = lambda z, q=fixed: z - q @ (q.T @ z)
        t = minres(product, without, -residual[:, todo], theta[todo], INNER)
        t = orthonormal(t, locked, space)
        if t.shape[1] == 0 and locked.shape[1] + space.shape[1] < d:
            fresh = np.random.default_rng(SEED + locked.shape[1] + space.shape[1]).standard_normal((d, 1))
            t = orthonormal(fresh, locked, space)
        if t.shape[1]:
            space, image = np.c_[space, t], np.c_[image, product(t)]
        else:
            image = product(space)  # W and the locked vectors span everything: only rounding is left
    raise ArithmeticError(f"residuals did not reach rounding in {OUTER} steps")


# --- sums over rows on Spark ------------------------------------------------------------------


def packed_rows(rows: DataFrame, d: int) -> DataFrame:
    """Distinct ``x`` in blocks: ``rows`` of them, their ``data`` and its ``kind``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = matrix(b.column("x").slice(at, BLOCK), d)
                data, kind = pack(part)
                yield pa.RecordBatch.from_pydict({"rows": [len(part)], "data": [data], "kind": [kind]}, schema=_BLOCKS)

    return rows.select("x").distinct().mapInArrow(blocks, "rows long, data binary, kind string")


_BLOCKS = pa.schema([("rows", pa.int64()), ("data", pa.binary()), ("kind", pa.string())])


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in batches:
        for data, kind in zip(b.column("data"), b.column("kind")):
            yield unpack(data.as_py(), kind.as_py(), d)


def totals(blocks: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension, in two halves that cannot overflow."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for x in _parts(batches, d):
            safe = largest(x) * len(x) <= LONG
            total = total + (x.astype(np.int64) if safe else x.astype(object)).sum(0).astype(object)
        high, low = zip(*(divmod(int(t), 1 << 32) for t in total))
        yield pa.RecordBatch.from_pydict({"i": list(range(d)), "high": list(high), "low": list(low)}, schema=halves)

    halves = pa.schema([("i", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
    found = blocks.mapInArrow(sums, "i int, high long, low long").groupBy("i").agg(F.sum("high"), F.sum("low")).collect()
    return [(h << 32) + low for _, h, low in sorted(tuple(r) for r in found)]


def summed(blocks: DataFrame, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over blocks of the matrix ``of`` gives for the block's centred rows.

    Tasks add up their own blocks; rows of the matrices meet by number, so no task and not the
    driver sees more than one matrix a task.
    """
    d = len(mean)
    rows, columns = of(np.zeros((0, d))).shape
    names = [f"c{j}" for j in range(columns)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for x in _parts(batches, d):
            total += of(x.astype(float) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *map(pa.array, total.T.copy())], ["i", *names])

    each = blocks.mapInArrow(sums, f"i int, {', '.join(f'{c} double' for c in names)}")
    found = each.groupBy("i").agg(*[F.sum(c) for c in names]).collect()
    return np.array([r[1:] for r in sorted((tuple(r) for r in found), key=lambda r: r[0])])


def fit(rows: DataFrame, d: int, wanted: int = COMPONENTS) -> Model | None:
    """Components of the distinct ``x`` of ``rows``; None where nothing varies."""
    blocks = materialize(packed_rows(rows, d), "whitening-fit")
    n = blocks.agg(F.sum("rows")).first()[0] or 0
    if n < 2 or d == 0:
        return None
    sums = totals(blocks, d)
    mean = np.array([s / n for s in sums])
    trace = float(summed(blocks, mean, lambda c: (c * c).sum(0, keepdims=True)).sum() / n)
    if trace == 0:
        return None
    values, vecs = jacobi_davidson(lambda u: summed(blocks, mean, lambda c: c.T @ (c @ u)) / n, d, wanted)
    varies = values > 64 * d * EPS * values[0]
    values, vecs = values[varies], vecs[:, varies]
    vecs = vecs * np.where(vecs[np.abs(vecs).argmax(0), range(len(values))] < 0, -1, 1)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ vecs / np.sqrt(values)
        return np.r_[w.T @ w, w.sum(0, keepdims=True)]

    found = summed(blocks, mean, moments) / n
    error = np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(values))).max()
    return Model(n, sums, values, vecs, trace, float(error))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of ``(n * x - sums) ** 2``; None beyond a long."""
    most = n * largest(x) + max(map(abs, sums))
    if most * most * x.shape[1] <= LONG:
        z = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (z * z).sum(1).tolist()
    z = n * x.astype(object) - np.array(sums, object)
    return [v if v <= LONG else None for v in (z * z).sum(1).tolist()]


RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "variance double"
)
_RESULT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
    + [(c, pa.float64()) for c in ("whitened", "explained", "identity_error", "variance")]
)


def whitened(rows: DataFrame, d: int, model: Model | None) -> DataFrame:
    """One row per row of ``rows`` (``vec_id``, ``x``) and component."""
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    k = len(model.values)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = model.mean
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = matrix(part.column("x"), d)
                w = (x.astype(float) - mean) @ model.components / np.sqrt(model.values)
                m = len(x)
                far = pa.array(deviations(x, model.n, model.sums), pa.int64())
                each = np.repeat(np.arange(m), k)
                columns = [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    far.take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                    pa.array(np.tile(model.values, m)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_RESULT)

    return rows.select("vec_id", "x").mapInArrow(of, RESULT)


def whiten(df: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    rows, d = vectors.integer_rows(df, vector, vec_id=F.col("vec_id").cast("long"))
    return whitened(rows, d, fit(rows, d, wanted))
