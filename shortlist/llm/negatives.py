"""Hard negatives by an exact inner-product search in a distributed multiway hyperplane tree.

An anchor's positives are the first ``POSITIVES`` other rows of its label; for each of them, the
first ``NEGATIVES`` rows of another label whose score lies between 80 and 100 per cent of the
positive's are its hard negatives.  Higher scores come first, then smaller ids.

* **Root.**  Split points come from a sample of at most ``SAMPLE`` vector entries, taken by hash;
  every row goes to its nearest split point.  One aggregation over all rows gives each split
  point's distance range to every sibling cell.  The root is bounded: ``CELLS`` split points.
* **Chunks.**  Cells are cut by hash into chunks of about ``CHUNK`` rows, so one hot vector or cell
  is many chunks.  A chunk and a block of anchors meet in one group of bounded size, where the
  lower levels of the tree are built over the chunk and searched for the whole block.
* **Passes.**  Anchors first search the chunk they lie in, which gives each a score that its
  positives must reach; then every chunk that the root cannot rule out, for positives; then, with
  the windows that the positives set, for negatives.  Lists of chunks merge by a top-k window.

Rows and anchors meet by equality of chunk and block; only chunks that the ranges leave are met.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite entry take no
part; vectors shorter than the longest are filled up with zeros; repeated rows are rows of their
own, so an anchor's copy may be its positive; a positive of negative score has an empty window; an
empty table gives no rows; scores that a long cannot hold stay at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import gnat
from .vectors import LONG, integer_rows, matrix

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative's score reaches so many hundredths of the positive's, and no more than all of it.
LEAST_PERCENT = 80
#: Vector entries of the sample that the root is fitted on, split points of the root, rows of a
#: chunk and anchors of a block.  Larger chunks and blocks ship fewer copies of each other.
SAMPLE = 1 << 18
CELLS = 64
CHUNK = 4096
BLOCK = 4096

_HITS = "row long, w int, id long, score long"
_HITS_ARROW = pa.schema([("row", pa.int64()), ("w", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def relabelled(vec_id: Column, label: Column) -> Column:
    """Every seventh row takes the next of ten labels: the noise that mining has to stand."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


@dataclass
class Root:
    """The tree's top: distance ranges of all rows, and the number of chunks of each cell."""

    ranges: gnat.Ranges
    chunks: list[int]
    blocks: int

    @property
    def first_chunk(self) -> np.ndarray:
        return np.cumsum([0, *self.chunks])


def _placed(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """Rows with the number of the nearest split point as ``cell``."""
    d = points.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), d).astype(float)
            cell = pa.array(gnat.distances(x, points).argmin(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, cell], [*b.schema.names, "cell"])

    return rows.mapInArrow(of, "vec_id long, label long, x array<bigint>, cell int")


def _measured(index: DataFrame, points: np.ndarray) -> Root:
    """Ranges and sizes over all rows, from one aggregation of a table per task."""
    m, d = points.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), d).astype(float)
            cell = b.column("cell").to_numpy()
            r = gnat.ranges(x, points, cell, gnat.distances(x, points))
            j, i = (g.ravel() for g in np.meshgrid(np.unique(cell).astype(np.int64), np.arange(m), indexing="ij"))
            ids = b.column("vec_id").to_numpy()
            count = lambda of: np.bincount(cell[of], minlength=m)[j] * (i == 0)
            columns = [j, i, r.near[i, j], r.far[i, j], r.least_norm[j], r.most_norm[j]]
            columns += [count(np.full(len(cell), True)), count(ids % ANCHOR_STEP == 0)]
            names = ["j", "i", "near", "far", "least", "most", "n", "anchors"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "j long, i long, near double, far double, least double, most double, n long, anchors long"
    each = index.select("vec_id", "x", "cell").mapInArrow(of, schema)
    found = each.groupBy("j", "i").agg(
        F.min("near"), F.max("far"), F.min("least"), F.max("most"), F.sum("n"), F.sum("anchors")
    )
    near, far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    least, most, sizes, anchors = np.full(m, np.inf), np.full(m, -1.0), np.zeros(m, int), 0
    for j, i, near[i, j], far[i, j], least[j], most[j], n, a in map(tuple, found.collect()):
        sizes[j] += n
        anchors += a
    chunks = [max(1, -(-int(n) // CHUNK)) for n in sizes]
    return Root(gnat.Ranges(points, near, far, least, most), chunks, max(1, -(-anchors // BLOCK)))


def _chunk(root: Root) -> Column:
    """The chunk of a row: the cell's first one, and a hash of the row within the cell."""
    first = F.array(*[F.lit(int(c)) for c in root.first_chunk[:-1]])
    count = F.array(*[F.lit(c) for c in root.chunks])
    return first[F.col("cell")] + F.pmod(F.xxhash64("row"), count[F.col("cell")].cast("long")).cast("int")


def _met(queries: DataFrame, root: Root, d: int, home: bool) -> DataFrame:
    """Queries once per chunk that their windows may meet; ``home`` leaves out their own."""
    first, counts = root.first_chunk, np.array(root.chunks)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("x"), d).astype(float)
            low = np.array([min(w, default=LONG) for w in b.column("lows").to_pylist()], np.int64)
            high = np.array([max(w, default=-LONG) for w in b.column("highs").to_pylist()], np.int64)
            who, cell = np.nonzero(root.ranges.alive(q, low, high) & (low <= high)[:, None])
            repeat = counts[cell]
            who, start = np.repeat(who, repeat), np.repeat(first[cell], repeat)
            chunk = start + np.arange(len(who)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            if home:
                other = chunk != b.column("chunk").to_numpy()[who]
                who, chunk = who[other], chunk[other]
            at = b.schema.get_field_index("chunk")
            for i in range(0, len(who), 8192):
                part = b.take(pa.array(who[i : i + 8192]))
                columns = list(part.columns)
                columns[at] = pa.array(chunk[i : i + 8192].astype(np.int32))
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return queries.mapInArrow(of, queries.schema)


def _hits(index: DataFrame, queries: DataFrame, root: Root, d: int, k: int, same: bool) -> DataFrame:
    """The best ``k`` of each query, window and chunk: ``row``, ``w``, ``id``, ``score``."""
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(root.blocks)).cast("int"))
    pairs = queries.select("chunk", "block").distinct()
    # new names for the columns, as queries are rows of the index too
    rows = index.select(*[F.col(c).alias(f"of_{c}") for c in ("chunk", "row", "vec_id", "label", "x")])
    rows = rows.join(pairs, F.col("of_chunk") == F.col("chunk")).drop("chunk").withColumnRenamed("block", "of_block")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS_ARROW.empty_table()
        of = lambda t, c: t.column(c).to_numpy()
        vectors = lambda t: matrix(t.column("x").combine_chunks(), d)
        left = left.rename_columns([c.removeprefix("of_") for c in left.column_names])
        tree = gnat.Search(vectors(left), of(left, "vec_id"), of(left, "label"), of(left, "row"), k)
        width = max(map(len, right.column("lows").to_pylist()))
        fill = lambda c, v: np.array([w + [v] * (width - len(w)) for w in right.column(c).to_pylist()], np.int64)
        low, high = fill("lows", LONG), fill("highs", -LONG)
        out = tree.run(vectors(right), of(right, "label"), of(right, "row"), low, high, same)
        q, w, place = np.nonzero(out[0] > -LONG)
        columns = [of(right, "row")[q], w.astype(np.int32), out[1][q, w, place], out[0][q, w, place]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_HITS_ARROW)

    return rows.groupBy("of_chunk", "of_block").cogroup(queries.groupBy("chunk", "block")).applyInArrow(search, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _windowed(anchors: DataFrame, lows: Column, highs: Column) -> DataFrame:
    return anchors.select("row", "label", "x", "chunk", lows.alias("lows"), highs.alias("highs"))


#: The least whole score of a window, in whole numbers; positives below zero have none.
_LEAST = f"if(p.positive_score >= 0, (p.positive_score div 100) * {LEAST_PERCENT} + (p.positive_score % 100 * {LEAST_PERCENT} + 99) div 100, {LONG})"
_MOST = f"if(p.positive_score >= 0, p.positive_score, -{LONG})"


def hard_negatives(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores."""
    spark = df.sparkSession
    vec_id = F.col("vec_id").cast("long")
    rows, d = integer_rows(
        df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()),
        vector,
        vec_id=vec_id,
        label=relabelled(vec_id, F.col("label").cast("long")),
    )
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], out)
    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").select("x").limit(max(CELLS, SAMPLE // max(1, d)))
    fitted = np.array([r.x for r in sample.collect()], float).reshape(-1, d)
    points = gnat.spread_points(fitted, min(CELLS, max(1, n // CHUNK)))
    index = materialize(_placed(rows, points).withColumn("row", F.monotonically_increasing_id()), "negatives-index")
    root = _measured(index, points)
    index = index.withColumn("chunk", _chunk(root))
    anchors = index.filter(F.col("vec_id") % ANCHOR_STEP == 0)

    one = lambda v: F.array(F.lit(v).cast("long"))
    at_home = materialize(
        _hits(index, _windowed(anchors, one(-LONG), one(LONG)), root, d, POSITIVES, True), "negatives-home"
    )
    reached = at_home.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = F.when(F.col("n") == POSITIVES, F.col("least")).otherwise(F.lit(-LONG))
    seeking = _windowed(anchors.join(reached, "row", "left"), F.array(least), one(LONG))
    elsewhere = _hits(index, _met(seeking, root, d, True), root, d, POSITIVES, True)
    positives = materialize(
        _best(at_home.unionByName(elsewhere), POSITIVES)
        .select("row", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row"),
        "negatives-positives",
    )

    own = F.sort_array(F.collect_list(F.struct("w", "positive_score")))  # POSITIVES entries at most
    of_anchor = positives.groupBy("row").agg(own.alias("p"))
    lows, highs = (F.expr(f"transform(p, p -> {bound})") for bound in (_LEAST, _MOST))
    windows = _windowed(anchors.join(of_anchor, "row"), lows, highs)
    found = _best(_hits(index, _met(windows, root, d, False), root, d, NEGATIVES, False), NEGATIVES)
    return found.join(positives, ["row", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
