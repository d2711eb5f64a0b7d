"""Packing of token sequences into windows of fixed length, online and in bounded space.

Each task reads its documents once and keeps at most ``OPEN`` windows.  A document (or what is
left of it) goes whole into the open window where it fits best; a new window is opened while
there are fewer than ``OPEN``.  When none fits, the fullest is emitted: it is first filled to
the last token with the head of the document, the tail goes on.  Documents longer than a
window give full windows at once.  So emitted windows have no padding.

What is open at the end of a task is poured together until less than one window is left.  These
leftovers merge in rounds, ``MERGE`` tasks' at a time, until a single one remains; that one is
cut into pieces of power-of-two lengths, which need no padding either.

Space per task: ``OPEN`` windows of ids, one document, and in a merge ``MERGE`` windows.

Defined cases: null and empty texts are the end id alone; repeated rows and ids are packed
each; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tokens

LENGTH = 4096
OPEN = 16
MERGE = 64
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "round int, part long, window long, offset long, open boolean, ids binary"
)
_FIELDS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    + [("round", pa.int32()), ("part", pa.int64()), ("window", pa.int64()), ("offset", pa.int64())]
    + [("open", pa.bool_()), ("ids", pa.binary())]
)
#: Pieces per Arrow batch that a task hands on.
_BATCH = 2048


class Window:
    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.fill = 0

    def put(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        self.pieces.append((doc_id, start, total, ids, self.fill))
        self.fill += len(ids)


class Packer:
    """Places runs of ids; yields windows that are done."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[Window] = []

    def place(self, doc_id, start: int, total: int, ids: np.ndarray) -> Iterator[Window]:
        while len(ids):
            if len(ids) >= self.length:
                w = Window()
                put = self.length
            else:
                fitting = [x for x in self.open if self.length - x.fill >= len(ids)]
                if fitting:
                    w = max(fitting, key=lambda x: x.fill)
                elif len(self.open) < self.most:
                    w = Window()
                    self.open.append(w)
                else:
                    w = max(self.open, key=lambda x: x.fill)
                put = min(len(ids), self.length - w.fill)
            w.put(doc_id, start, total, ids[:put])
            start, ids = start + put, ids[put:]
            if w.fill == self.length:
                if w in self.open:
                    self.open.remove(w)
                yield w

    def pour(self) -> Iterator[Window]:
        """Fills windows from the open ones until at most one is left."""
        rest = Packer(self.length, 1)
        for w in sorted(self.open, key=lambda x: -x.fill):
            for doc_id, start, total, ids, _ in w.pieces:
                yield from rest.place(doc_id, start, total, ids)
        self.open = rest.open


def by_powers(w: Window) -> Iterator[Window]:
    """The last window cut into windows of power-of-two lengths, largest first."""
    sizes = [1 << b for b in range(w.fill.bit_length() - 1, -1, -1) if w.fill >> b & 1]
    pieces = list(w.pieces)
    for size in sizes:
        out = Window()
        while out.fill < size:
            doc_id, start, total, ids, _ = pieces.pop(0)
            put = min(len(ids), size - out.fill)
            out.put(doc_id, start, total, ids[:put])
            if put < len(ids):
                pieces.insert(0, (doc_id, start + put, total, ids[put:], 0))
        yield out


class _Rows:
    """Pieces of done and open windows as Arrow batches."""

    def __init__(self, round_: int, part: int, keep_ids: bool):
        self.round, self.part, self.keep = round_, part, keep_ids
        self.rows: list[tuple] = []
        self.windows = 0

    def add(self, w: Window, open_: bool) -> None:
        for doc_id, start, total, ids, offset in w.pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append(
                (doc_id, start, len(ids), zlib.crc32(raw), total, self.round, self.part, self.windows, offset, open_,
                 raw if open_ or self.keep else None)
            )
        self.windows += 1

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= _BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.types)], schema=_FIELDS)


def first_round(
    docs: DataFrame, vocabulary: str, end_id: int, length: int, most: int, keep_ids: bool
) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.word_encoder(vocabulary), Packer(length, most)
        rows = _Rows(0, TaskContext.get().partitionId(), keep_ids)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, tokens.BATCH):
                some = batch.slice(at, tokens.BATCH)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode_all(some.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for w in packer.place(doc_id, 0, len(ids), ids):
                        rows.add(w, False)
                yield from rows.full()
        for w in packer.pour():
            rows.add(w, False)
        for w in packer.open:
            rows.add(w, True)
        yield from rows.flush()

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def merge_round(left: DataFrame, round_: int, last: bool, length: int, keep_ids: bool) -> DataFrame:
    """Leftovers of ``MERGE`` parts poured together; the last round ends in powers of two."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        part = int(key[0].as_py())
        table = table.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        packer, rows = Packer(length, 1), _Rows(round_, part, keep_ids)
        for r in table.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            for w in packer.place(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")):
                rows.add(w, False)
        for w in packer.open:
            for done in by_powers(w) if last else [w]:
                rows.add(done, not last)
        return pa.Table.from_batches(list(rows.flush()), schema=_FIELDS)

    grouped = left.withColumn("into", F.floor(F.col("part") / MERGE))
    return grouped.groupBy("into").applyInArrow(lambda key, t: merge(key, t.drop_columns(["into"])), SCHEMA)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = END_ID,
    length: int = LENGTH,
    most: int = OPEN,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): document, start, length, checksum, sequence and offset, and ids.

    ``vocabulary`` is the path of a word-level tokenizer file, as each worker sees it.
    """
    pieces = materialize(first_round(docs, vocabulary, end_id, length, most, keep_ids), "packed-0")
    done, left, round_ = [pieces.where(~F.col("open"))], pieces.where("open"), 0
    while True:
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        round_ += 1
        last = parts < MERGE
        pieces = materialize(merge_round(left, round_, last, length, keep_ids), f"packed-{round_}")
        done.append(pieces.where(~F.col("open")))
        left = pieces.where("open")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", _sequence().alias("sequence_id"), "offset", "ids"
    )


def _sequence() -> Column:
    """Round, part and window in one number."""
    return F.col("round") * F.lit(2**56) + F.col("part") * F.lit(2**24) + F.col("window")


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
