"""Files of token ids in canonical, length-limited Huffman codes.

Ids are counted over all documents; package-merge gives the best code with no word longer than
``MAX_BITS`` bits, and the code words follow from the lengths alone (canonical order: length,
then id).  Documents are dealt by ranges of their id and written in that order, one file per
range.

File: magic, then the packed code lengths, then blocks.  A block is decoded by itself: it has
the documents it holds pieces of, the bit offset of every ``STRIDE``-th id, and the bits.
Decoding looks up ``MAX_BITS`` bits at a time in one table, for all checkpoints at once.  A
reader that wants few ids starts at the checkpoint before them.

Defined cases: null and empty texts are the end id alone; repeated rows and ids are all written,
equal ids in the order of their length; null ids come first; an empty table gives no file
and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import files, tokens

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Small enough that the decoding table stays near the processor.
MAX_BITS = 17
STRIDE = 256
BLOCK = 1 << 20
MAGIC = b"HUFIDS1\n"
#: In place of a number of ids: the row holds counts.
COUNTS = -1

_HEAD = struct.Struct("<II")  # size of the vocabulary, bytes of the packed lengths
_BLOCK = struct.Struct("<IIIII")  # ids, pieces, stride, bytes of bits, checksum of ids
_PIECE = struct.Struct("<?q?I")  # has an id, the id, ends its document, ids in this block

MANIFEST = "part long, name string, documents long, ids long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


class FileError(ValueError):
    """A file that breaks the format."""


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length per id by package-merge; ids that never occur have none."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, leaves = weight, []
    for _ in range(limit):
        # which entries of this level, in order of weight, are single ids
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1) if leaves else weight[:0]
        both = np.concatenate([weight, packages])
        place = np.argsort(both, kind="stable")
        leaves.append(place < len(weight))
        level = both[place]
    take = 2 * len(weight) - 2
    lengths = np.zeros(len(weight), np.uint8)
    for is_leaf in reversed(leaves):
        singles = int(is_leaf[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


@dataclass
class Code:
    lengths: np.ndarray
    words: np.ndarray
    bits: int
    ids: np.ndarray
    steps: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        """Canonical code words and the decoding table."""
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        bits = int(lengths.max(initial=1))
        span = np.int64(1) << (bits - lengths[order].astype(np.int64))
        begin = np.cumsum(span) - span
        words = np.zeros(len(lengths), np.uint64)
        words[order] = begin >> (bits - lengths[order].astype(np.int64))
        ids, steps = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
        filled = int(span.sum())
        ids[:filled], steps[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
        return cls(lengths, words, bits, ids, steps)

    def packed(self) -> bytes:
        raw = zlib.compress(self.lengths.tobytes())
        return MAGIC + _HEAD.pack(len(self.lengths), len(raw)) + raw

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every ``STRIDE``-th id, and the bits."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        at = ends - size
        shifted = self.words[ids] << (64 - (at & 31) - size).astype(np.uint64)
        slot, n = at >> 5, int(ends[-1] >> 5) + 2 if len(ids) else 2
        # bits of different ids never overlap, so sums stand for unions; both stay below 2**53
        high = np.bincount(slot, (shifted >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(slot + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return at[::STRIDE].astype("<u8"), (high + low).astype(">u4").tobytes()

    def decode(self, checkpoints: np.ndarray, bits: bytes, n: int, stride: int) -> np.ndarray:
        """All ids from the checkpoints on, ``stride`` each."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        pairs = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
        last, mask = len(pairs) - 1, np.uint64((1 << self.bits) - 1)
        at = checkpoints.astype(np.int64)
        out = np.empty((min(stride, n) if len(at) else 0, len(at)), np.uint32)
        for row in out:
            found = (pairs[np.minimum(at >> 5, last)] >> (64 - self.bits - (at & 31)).astype(np.uint64)) & mask
            row[:] = self.ids[found]
            at = at + self.steps[found]
        return out.T.reshape(-1)[:n]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``n`` and ``ids`` (little-endian, 16 bits where they fit), materialized.

    Each task ends with a row of its own: ``n`` is ``COUNTS``, ``ids`` how often it met each id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.byte_encoder(vocabulary)
        size = encoder.tokenizer.get_vocab_size()
        kind, counts, end = id_type(size), np.zeros(size, np.int64), np.array([end_id], np.uint32)
        fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, tokens.BATCH):
                some = batch.slice(at, tokens.BATCH)
                ids = [np.concatenate([x, end]) for x in encoder.encode_column(some.column(1))]
                counts += np.bincount(np.concatenate(ids), minlength=size)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": some.column(0), "n": [len(x) for x in ids], "ids": [x.astype(kind).tobytes() for x in ids]},
                    schema=fields,
                )
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "n": [COUNTS], "ids": [counts.astype("<i8").tobytes()]}, schema=fields)

    return materialize(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n long, ids binary"), "token-ids")


def id_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def counted(ids: DataFrame, vocabulary_size: int) -> np.ndarray:
    """Occurrences of every id, from the tasks' counts; at most one row per id reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]})

    rows = ids.where(F.col("n") == COUNTS).select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary_size, np.int64)
    for r in rows.toLocalIterator():
        out[r["id"]] = r["n"]
    return out


class Writer:
    """One file; documents in, blocks out."""

    def __init__(self, out, code: Code):
        self.out, self.code = out, code
        self.pieces: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.waiting = self.documents = self.ids = 0
        self.bytes = out.write(head := code.packed()) or len(head)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents, self.ids = self.documents + 1, self.ids + len(ids)
        while True:
            part, ids = ids[: BLOCK - self.waiting], ids[BLOCK - self.waiting :]
            self.pieces.append(_PIECE.pack(doc_id is not None, doc_id or 0, not len(ids), len(part)))
            self.parts.append(part)
            self.waiting += len(part)
            if self.waiting == BLOCK:
                self.block()
            if not len(ids):
                return

    def block(self) -> None:
        if not self.pieces:
            return
        ids = np.concatenate(self.parts).astype(np.int64)
        checkpoints, bits = self.code.encode(ids)
        head = _BLOCK.pack(len(ids), len(self.pieces), STRIDE, len(bits), zlib.crc32(ids.astype("<u4").tobytes()))
        for raw in (head, *self.pieces, checkpoints.tobytes(), bits):
            self.out.write(raw)
            self.bytes += len(raw)
        self.pieces, self.parts, self.waiting = [], [], 0

    def close(self) -> None:
        self.block()
        self.out.close()


def write(ids: DataFrame, code: Code, folder: str, vocabulary_size: int) -> DataFrame:
    """Files of all documents in id order; their manifest, materialized."""
    kind = id_type(vocabulary_size)
    shared = ids.sparkSession.sparkContext.broadcast(code)  # a few bytes per id of the vocabulary

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                if out is None:
                    name = files.attempt_name(part, ".huf")
                    out = Writer(files.create(folder, name), shared.value)
                out.add(doc_id, np.frombuffer(raw.as_buffer(), kind))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "name": [name], "documents": [out.documents], "ids": [out.ids], "bytes": [out.bytes]}
            )

    ranged = ids.where(F.col("n") != COUNTS).repartitionByRange("doc_id", "n").sortWithinPartitions("doc_id", "n").select("doc_id", "ids")
    return materialize(ranged.mapInArrow(save, MANIFEST), "token-files")


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise FileError("the file ends early")
    return data


def read_code(stream) -> Code:
    if _exactly(stream, len(MAGIC)) != MAGIC:
        raise FileError("not a file of token ids")
    size, packed = _HEAD.unpack(_exactly(stream, _HEAD.size))
    lengths = np.frombuffer(zlib.decompress(_exactly(stream, packed)), np.uint8)
    if len(lengths) != size:
        raise FileError("code lengths are missing")
    return Code.of(lengths)


def read_blocks(stream, code: Code) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Pieces (doc_id, ends its document, ids here) and ids of each block."""
    while head := stream.read(_BLOCK.size):
        if len(head) != _BLOCK.size:
            raise FileError("the file ends early")
        n, pieces, stride, size, checksum = _BLOCK.unpack(head)
        listed = [_PIECE.unpack(_exactly(stream, _PIECE.size)) for _ in range(pieces)]
        checkpoints = np.frombuffer(_exactly(stream, 8 * -(-n // stride)), "<u8")
        ids = code.decode(checkpoints, _exactly(stream, size), n, stride)
        if zlib.crc32(ids.astype("<u4").tobytes()) != checksum or sum(p[3] for p in listed) != n:
            raise FileError("a block differs from its checksum")
        yield [(d if known else None, end, k) for known, d, end, k in listed], ids


def documents(stream) -> Iterator[tuple[int | None, int, int, int]]:
    """doc_id, ids before it in the file, number of ids, checksum of all of them."""
    start = n = crc = 0
    for pieces, ids in read_blocks(stream, read_code(stream)):
        at = 0
        for doc_id, end, k in pieces:
            crc = zlib.crc32(ids[at : at + k].astype("<u4").tobytes(), crc)
            at, n = at + k, n + k
            if end:
                yield doc_id, start, n, crc
                start, n, crc = start + n, 0, 0
    if n:
        raise FileError("the last document is cut off")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files in ``manifest``; ``start`` counts ids over all files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                with files.read(folder, name) as stream:
                    found: list[tuple] = []
                    for doc_id, start, n, crc in documents(stream):
                        found.append((doc_id, before + start, n, crc))
                        if len(found) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_READ)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_READ)

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("name", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(rows, READ)


def vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size()


def save(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to ``folder``; the manifest."""
    size = vocabulary_size(vocabulary)
    ids = tokenized(docs, vocabulary, end_id)
    return write(ids, Code.of(code_lengths(counted(ids, size))), folder, size)
