"""Exact top-k by set similarity, a block of queries against a chunk of index sets at a time.

Overlaps of a block with a slice of a chunk are one product of 0/1 matrices over the block's own
vocabulary.  Each query carries a floor, the k-th best similarity it has found; a slice goes when
the lengths in it cannot reach any floor, a row goes when it holds too few features of the block's
vocabulary, and nothing below a floor is sorted.

Two plans bring blocks and chunks together:

* ``scan_sets`` ships a query table of checked size to every task, a larger one in passes; the
  index stays in place.
* ``join_sets`` has no bound on either side.  Sets are cut by length into buckets, and buckets by
  hash into chunks.  Queries first meet one chunk of their own length, which gives a floor; then
  the chunks whose lengths can still reach it.  Lists of k merge in two levels, so that no window
  sees a query's lists from every chunk at once.

Both take and give rows of distinct sets; a set that shares nothing with a query is not returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Lengths of one bucket lie within this factor of each other.
BUCKET = 1.2
#: Index sets of a chunk and queries of a block; both sides of one task are bounded by them.  An
#: index set is moved once per block and a query once per chunk in its reach.
CHUNK = 8192
BLOCK = 16384
#: Queries and vocabulary of one matrix product, and the cells of its larger side.
STEP = 256
VOCABULARY = 4096
CELLS = 1 << 22
#: Cells of a chunk that are laid out once for all blocks of a small vocabulary: 130 MB.
KEPT = 1 << 25

FOUND = "q_key string, set_key string, similarity double, first_pos long"
_FOUND = pa.schema(
    [("q_key", pa.string()), ("set_key", pa.string()), ("similarity", pa.float64()), ("first_pos", pa.int64())]
)

#: No list: queries, similarities, positions, keys.
_NONE = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))


@dataclass
class Sets:
    """Sets by rising size, their elements one after the other."""

    keys: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray
    flat: np.ndarray
    pos: np.ndarray

    @classmethod
    def of(cls, keys: list, bits: pa.Array, pos: np.ndarray) -> tuple[Sets, np.ndarray]:
        """The sets, and the place each had before they were put in order."""
        sizes = bits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        flat = bits.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = sizes[order]
        return cls(np.asarray(keys, object)[order], sizes, np.cumsum(sizes), flat, np.asarray(pos)[order]), order

    def __post_init__(self) -> None:
        self.vocabulary, self.codes = np.unique(self.flat, return_inverse=True)

    def codes_of(self, lo: int, hi: int) -> np.ndarray:
        """Elements of the sets from ``lo`` to ``hi``, as places in the vocabulary."""
        return self.codes[self.ends[lo] - self.sizes[lo] : self.ends[hi - 1]]

    def dense(self, lo: int, hi: int, columns: np.ndarray, width: int) -> np.ndarray:
        """Those sets as rows of a 0/1 matrix; ``columns`` places the vocabulary, -1 leaves out."""
        out = np.zeros((hi - lo, width), np.float32)
        at = columns[self.codes_of(lo, hi)]
        known = at >= 0
        out[np.repeat(np.arange(hi - lo), self.sizes[lo:hi])[known], at[known]] = 1
        return out


class Nearest:
    """The k best sets of every query so far; ``floor`` is each query's k-th best similarity."""

    def __init__(self, queries: Sets, k: int, floor: np.ndarray | None = None):
        self.q, self.k = queries, k
        self.floor = np.zeros(len(queries.keys)) if floor is None else floor.copy()
        self.blocks = list(self._blocks())
        # lists are kept by block, at its first query; empty queries, which come first, are at 0
        self.best = {lo: _NONE for lo in [0, *(lo for lo, _ in self.blocks)]}

    def _blocks(self) -> Iterator[tuple[int, int]]:
        """Cuts that keep a block within ``STEP`` queries and, if it has several, ``VOCABULARY`` elements."""
        lo = int(np.searchsorted(self.q.sizes, 1))
        while lo < len(self.q.sizes):
            hi = min(lo + STEP, len(self.q.sizes))
            while hi - lo > 1 and len(np.unique(self.q.codes_of(lo, hi))) > VOCABULARY:
                hi = lo + (hi - lo) // 2
            yield lo, hi
            lo = hi

    def meet(self, x: Sets) -> None:
        blank_q, blank_x = np.flatnonzero(self.q.sizes == 0), np.flatnonzero(x.sizes == 0)
        if len(blank_q) and len(blank_x):
            first = blank_x[np.argsort(x.pos[blank_x], kind="stable")[: self.k]]
            q, r = (g.ravel() for g in np.meshgrid(blank_q, first, indexing="ij"))
            self._keep(0, q, np.ones(len(q)), x, r)
        every = np.arange(len(self.q.vocabulary))
        # a small vocabulary serves all blocks, and the rows of x are laid out once for them
        shared = len(every) <= VOCABULARY and len(every) * len(x.keys) <= KEPT
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for lo, hi in self.blocks:
            used = every if shared else np.unique(self.q.codes_of(lo, hi))
            vocabulary = self.q.vocabulary[used]
            columns = np.full(len(self.q.vocabulary), -1)
            columns[used] = np.arange(len(used))
            mine = self.q.dense(lo, hi, columns, len(used)).T.copy()
            at = np.minimum(np.searchsorted(vocabulary, x.vocabulary), len(vocabulary) - 1)
            columns = np.where(vocabulary[at] == x.vocabulary, at, -1)
            step = max(1, CELLS // max(len(vocabulary), STEP if shared else hi - lo))
            slices = [(a, min(a + step, len(x.keys))) for a in range(int(np.searchsorted(x.sizes, 1)), len(x.keys), step)]
            middle = np.median(self.q.sizes[lo:hi])
            for a, b in sorted(slices, key=lambda s: abs(x.sizes[(s[0] + s[1]) // 2] - middle)):
                n, floor = self.q.sizes[lo:hi], self.floor[lo:hi]
                if not (np.minimum(n, x.sizes[b - 1]) >= floor * np.maximum(n, x.sizes[a]) - 1e-9).any():
                    continue
                rows = held.get(a)
                if rows is None:
                    theirs = x.dense(a, b, columns, len(mine))
                    rows = theirs, theirs.sum(1)
                    if shared:
                        held[a] = rows
                self._compare(lo, hi, mine, x, a, b, *rows)

    def _compare(self, lo: int, hi: int, mine: np.ndarray, x: Sets, a: int, b: int, theirs: np.ndarray, known: np.ndarray) -> None:
        n, floor = self.q.sizes[lo:hi], self.floor[lo:hi]
        # an overlap of at least floor / (1 + floor) of both sizes is needed
        share = floor / (1 + floor)
        rich = known >= (share * n).min() + share.min() * x.sizes[a:b] - 1e-6
        if not rich.any():
            return
        rows = np.flatnonzero(rich)
        sizes = x.sizes[a:b][rows]
        shared = (theirs[rows] if len(rows) < b - a else theirs) @ mine
        # single precision proposes, with room for its rounding; what it lets through is compared exactly
        least = np.multiply.outer(sizes.astype(np.float32), share.astype(np.float32))
        least += (share * n).astype(np.float32)
        least *= np.float32(1 - 1e-5)
        least = np.maximum(least, np.float32(0.5), out=least)
        cells = np.flatnonzero(shared >= least)
        if len(cells) > 8 * self.k * (hi - lo) and len(rows) > 4 * self.k:  # k rows of this slice alone may raise the floor
            similarity = shared / (sizes[:, None] + n - shared.astype(np.float64))
            floor = np.maximum(floor, np.partition(similarity, len(rows) - self.k, axis=0)[len(rows) - self.k])
            cells = np.flatnonzero((shared > 0) & (similarity >= floor))
        r, c = np.divmod(cells, hi - lo)
        both = shared.ravel()[cells].astype(np.float64)
        similarity = both / (sizes[r] + n[c] - both)
        good = similarity >= floor[c]
        if good.any():
            self._keep(lo, c[good] + lo, similarity[good], x, rows[r[good]] + a)

    def _keep(self, block: int, q: np.ndarray, similarity: np.ndarray, x: Sets, rows: np.ndarray) -> None:
        new = (q, similarity, x.pos[rows], x.keys[rows])
        q, s, pos, keys = (np.concatenate([o, n]) for o, n in zip(self.best[block], new))
        order = np.lexsort((pos, -s, q))
        q, s, pos, keys = q[order], s[order], pos[order], keys[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        kept = place < self.k
        self.best[block] = tuple(o[kept] for o in (q, s, pos, keys))

    def found(self) -> dict[str, pa.Array]:
        q, s, pos, keys = (np.concatenate(c) for c in zip(*self.best.values()))
        columns = (self.q.keys[q].tolist(), keys.tolist(), s, pos)
        return {f.name: pa.array(c, f.type) for f, c in zip(_FOUND, columns)}


def _list(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def scan_sets(
    queries: DataFrame, sets: DataFrame, k: int, *, least: float = 0.0, passes: int = 1, proposed=None, also: Sequence[str] = ()
) -> DataFrame:
    """The k best sets of similarity ``least`` or more per query, by ``passes`` scans of the index in place.

    A pass ships one part of the queries, by hash, to every task, and only lists of k leave a task.
    ``proposed(batch, local)`` may rule rows of an index batch out before they are compared;
    ``local`` are the rows of ``queries`` in the task.  Both sides carry the columns ``also`` for it.
    """
    index = sets.withColumn("first_pos", F.col("first_pos").cast("long"))
    index = index.select("set_key", "first_pos", "bits", *also)
    if passes > 1:
        queries, index = materialize(queries, "scanned"), materialize(index, "sets")
        # a task gives up to k sets per query of a pass: as many tasks as cores, not as many as file splits
        index = index.coalesce(index.sparkSession.sparkContext.defaultParallelism)
    found = None
    for p in range(passes):
        mine = queries.filter(F.pmod(F.xxhash64("set_key"), F.lit(passes)) == p).select("set_key", "bits", *also)
        table = mine.sparkSession.sparkContext.broadcast(mine.toArrow().combine_chunks())
        part = best_of(index.mapInArrow(_scan(table, k, least, proposed), FOUND), k)
        if passes > 1:  # the next part of the queries takes the place of this one
            part = materialize(part, "scanned-lists")
            table.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _scan(table, k: int, least: float, proposed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = table.value
        n = local.num_rows
        of = lambda t, pos: Sets.of(t.column("set_key").to_pylist(), _list(t.column("bits")), pos)[0]
        state = Nearest(of(local, np.zeros(n, np.int64)), k, np.full(n, least))
        for b in batches:
            if proposed is not None:
                b = b.filter(pa.array(proposed(b, local)))
            if b.num_rows:
                state.meet(of(b, b.column("first_pos").to_numpy()))
        yield pa.RecordBatch.from_pydict(state.found(), schema=_FOUND)

    return run


def best_of(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy("q_key", *by).orderBy(F.desc("similarity"), F.asc("first_pos"))
    return found.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


# --- any number of queries ---------------------------------------------------------------------


def length_bucket(n: Column) -> Column:
    """Empty sets in the first bucket; the others by the logarithm of their length."""
    return F.when(n <= 0, F.lit(0)).otherwise(1 + F.floor(F.log(n.cast("double")) / F.log(F.lit(BUCKET)))).cast("int")


@dataclass(frozen=True)
class Bucket:
    """Lengths found in a bucket, and the chunks it is cut into."""

    number: int
    low: int
    high: int
    first: int
    chunks: int

    def literal(self) -> str:
        return f"named_struct('b', {self.number}, 'lo', {self.low}, 'hi', {self.high}, 'first', {self.first}, 'n', {self.chunks})"


def buckets(sets: DataFrame, size: int) -> list[Bucket]:
    """One per bucket that holds sets: their number grows with the logarithm of the longest set.

    Neighbouring buckets that fill no chunk share one, so that there are at most twice as many
    chunks as full ones, however the lengths are spread.
    """
    found = sets.groupBy(length_bucket(F.col("n")).alias("b")).agg(F.min("n"), F.max("n"), F.count(F.lit(1)))
    out, first, held = [], 0, 0
    for b, low, high, n in sorted(tuple(r) for r in found.collect()):
        if held and held + n > size:
            first, held = first + 1, 0
        out.append(Bucket(b, low, high, first, -(-n // size)))
        if n > size:
            first += out[-1].chunks
        else:
            held += n
    return out


def _literals(all_buckets: list[Bucket]) -> str:
    return f"array({', '.join(b.literal() for b in all_buckets)})"


def _in_chunks(sets: DataFrame, all_buckets: list[Bucket], key: str, out: str) -> DataFrame:
    """Sets with the number of their chunk: the bucket's first, and a hash within the bucket."""
    own = F.expr(f"filter({_literals(all_buckets)}, x -> x.b = __b)[0]")
    return (
        sets.withColumn("__b", length_bucket(F.col("n")))
        .withColumn("__own", own)
        .withColumn(out, (F.col("__own.first") + F.pmod(F.xxhash64(key), F.col("__own.n").cast("long"))).cast("int"))
        .drop("__b", "__own")
    )


def _near(queries: DataFrame, all_buckets: list[Bucket]) -> DataFrame:
    """Each query with one chunk of the bucket nearest to its own length."""
    apart = "struct(greatest(q_n, x.hi) / greatest(least(q_n, x.lo), 0.5D) AS apart, x.first AS first, x.n AS n)"
    nearest = F.expr(f"array_min(transform({_literals(all_buckets)}, x -> {apart}))")
    return (
        queries.withColumn("__at", nearest)
        .withColumn("chunk", (F.col("__at.first") + F.pmod(F.xxhash64("q_key"), F.col("__at.n").cast("long"))).cast("int"))
        .drop("__at")
    )


def _reachable(queries: DataFrame, all_buckets: list[Bucket]) -> DataFrame:
    """Each query with every chunk, its first one left out, whose lengths can reach its floor.

    A set of n elements and one of m are at most min / max alike; the slack keeps rounding from
    losing a tie, and the comparison in the task is exact.
    """
    most = "least(greatest(q_n, x.lo), x.hi)"  # the length of the bucket nearest to the query's
    fits = f"q_n = 0 AND x.lo = 0 OR q_n > 0 AND x.hi > 0 AND least(q_n, {most}) >= floor * greatest(q_n, {most}) - 1e-9D"
    chunks = f"flatten(transform(filter({_literals(all_buckets)}, x -> {fits}), x -> sequence(x.first, x.first + x.n - 1)))"
    chunks = f"array_distinct({chunks})"
    return (
        queries.withColumn("met", F.explode(F.expr(chunks)))
        .filter(F.col("met") != F.col("chunk"))
        .withColumn("chunk", F.col("met"))
        .drop("met")
    )


def met(queries: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The k best sets of every (query, chunk) pair of ``queries``, which carries ``floor``."""
    pairs = queries.select("chunk", "block").distinct()
    index = sets.select(*[F.col(c).alias(f"x_{c}") for c in ("chunk", "set_key", "first_pos", "bits")])
    index = index.join(pairs, F.col("x_chunk") == F.col("chunk")).withColumnRenamed("block", "x_block").drop("chunk")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        column = lambda t, c: t.column(c).to_numpy()
        q, order = Sets.of(right.column("q_key").to_pylist(), _list(right.column("q_bits")), np.zeros(right.num_rows, np.int64))
        state = Nearest(q, k, column(right, "floor")[order])
        state.meet(Sets.of(left.column("x_set_key").to_pylist(), _list(left.column("x_bits")), column(left, "x_first_pos"))[0])
        found = state.found()
        return pa.Table.from_pydict({**found, "chunk": pa.array([key[0].as_py()] * len(found["q_key"]), pa.int64())}, schema=schema)

    schema = _FOUND.append(pa.field("chunk", pa.int64()))
    both = index.groupBy("x_chunk", "x_block").cogroup(queries.groupBy("chunk", "block"))
    return both.applyInArrow(run, f"{FOUND}, chunk long")


def join_sets(queries: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The k best sets per query for any number of queries; both sides as distinct sets."""
    sets = materialize(sets.select("set_key", "n", F.col("first_pos").cast("long").alias("first_pos"), "bits"), "sets")
    lengths = buckets(sets, CHUNK)
    of_queries = buckets(queries, BLOCK)
    if not lengths or not of_queries:
        return queries.sparkSession.createDataFrame([], FOUND)
    index = _in_chunks(sets, lengths, "set_key", "chunk")
    asked = _in_chunks(queries.select("set_key", "n", "bits"), of_queries, "set_key", "block").select(
        F.col("set_key").alias("q_key"), F.col("n").alias("q_n"), F.col("bits").alias("q_bits"), "block"
    )
    asked = _near(asked, lengths)
    first = materialize(met(asked.withColumn("floor", F.lit(0.0)), index, k), "nearest-first")
    reached = first.groupBy(F.col("q_key").alias("r_key")).agg(F.min("similarity").alias("least"), F.count("*").alias("have"))
    floor = F.when(F.col("have") >= k, F.col("least")).otherwise(F.lit(0.0))
    bounded = asked.join(reached, F.col("q_key") == F.col("r_key"), "left").withColumn("floor", floor)
    rest = met(_reachable(bounded.drop("r_key", "least", "have"), lengths), index, k)
    groups = max(1, round(max(b.first + b.chunks for b in lengths) ** 0.5))
    lists = first.unionByName(rest).withColumn("part", F.col("chunk") % groups)
    return best_of(best_of(lists, k, "part").drop("part", "chunk"), k)
