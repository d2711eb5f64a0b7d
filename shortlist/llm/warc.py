"""Zstandard WARC archives with a shared dictionary, one frame per record, and a strict reader.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame per record.
The dictionary is fitted on a bounded sample of payloads (``SAMPLE`` rows with the smallest
hash, a share of at most ``SAMPLE_BYTES``) and goes into every archive, so that each can be
read alone.

Of records with equal payloads (by SHA-1) of at least ``LEAST_BYTES`` bytes, the one with the
largest id holds the payload as a response; the others are revisits that name it.

The reader takes an archive from front to back, a frame at a time: dictionary first, then for
each record the version line, the mandatory fields, the block length against
``Content-Length``, the closing line breaks, and block and payload digests.

Defined cases: a null payload is empty; rows equal to the largest id of a payload are all
responses; null ids are written without id, never named by a revisit, and responses where no
row of the payload has an id; null addresses are left out; control characters and spaces in addresses
are percent-encoded; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import files

LEAST_BYTES = 0
#: Bounds of the sample for the dictionary, and the dictionary's size.
SAMPLE = 400
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 and Zstandard formats.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_READ = 1 << 15

MANIFEST = "name string, records long, bytes long"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)
_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's fields and payload, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version != VERSION:
        raise ArchiveError(f"not a {VERSION.decode()} record")
    fields: dict[str, str] = {}
    for line in lines.decode("utf-8", "surrogatepass").split("\r\n"):
        name, mark, value = line.partition(":")
        if not mark or not name.strip():
            raise ArchiveError(f"malformed field {line!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [n for n in MANDATORY if n not in fields]:
        raise ArchiveError(f"missing fields {missing}")
    if not fields["content-length"].isdigit():
        raise ArchiveError("Content-Length is not a number")
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ArchiveError(f"the block is not of {size} bytes and two line breaks")
    if fields.get("warc-block-digest", f"sha1:{sha1_base32(block)}") != f"sha1:{sha1_base32(block)}":
        raise ArchiveError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not http.startswith(b"HTTP/") or not length:
        raise ArchiveError("malformed HTTP head")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (digest != sha1_base32(payload) or int(length[1]) != len(payload)):
        raise ArchiveError("payload digest or length differs")
    if fields["warc-type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ArchiveError("a revisit has a payload or names no record")
    if fields["warc-type"] not in ("response", "revisit"):
        raise ArchiveError(f"unexpected type {fields['warc-type']}")
    return {
        "page_id": _number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ArchiveError("the archive ends early")
    return data


def frames(stream) -> Iterator[bytes]:
    """The frames of an archive, decoded: the dictionary is read first."""
    import zstandard

    magic, size = (int.from_bytes(_exactly(stream, 4), "little") for _ in range(2))
    if magic != DICTIONARY_MAGIC:
        raise ArchiveError("no dictionary frame")
    raw = _exactly(stream, size)
    if raw[:4] == zstandard.FRAME_HEADER:
        raw = zstandard.decompress(raw)
    if raw and raw[:4] != ZSTD_DICTIONARY_MAGIC:
        raise ArchiveError("not a dictionary")
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = stream.read(_READ)
    while rest:
        decoder = context.decompressobj()
        out = []
        while not decoder.eof:
            if not rest:
                raise ArchiveError("the last frame is cut off")
            try:
                out.append(decoder.decompress(rest))
            except zstandard.ZstdError as e:
                raise ArchiveError(str(e)) from e
            rest = decoder.unused_data if decoder.eof else stream.read(_READ)
        yield b"".join(out)
        if not rest:
            rest = stream.read(_READ)


def fitted_dictionary(payloads: DataFrame) -> bytes:
    """Dictionary from a bounded sample of ``payload``; empty where the sample is too small for one."""
    import zstandard

    hashed = payloads.select(F.xxhash64("page_id", "payload").alias("h"), F.substring("payload", 1, SAMPLE_BYTES).alias("p"))
    most = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # numbers only leave the tasks
    sample = hashed.where(F.col("h") <= most).dropDuplicates(["h"]) if most is not None else hashed.limit(0)
    rows = sample.orderBy("h").limit(SAMPLE).collect()  # SAMPLE x SAMPLE_BYTES at most
    samples = [record(0, "http://x.example/", bytes(r.p), None, False) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def planned(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``revisit`` and ``refers_to``.

    Holders of payloads are found by digest and length alone; digests that occur once drop out
    before the join.
    """
    digest = F.sha1("payload")
    rows = pages.select("page_id", "url", "payload", digest.alias("digest"))
    shared = materialize(
        rows.where(F.octet_length("payload") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("holder"))
        .where("n > 1 AND holder IS NOT NULL")
        .select(F.col("digest").alias("shared"), "holder"),
        "warc-holders",
    )
    revisit = F.coalesce(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.lit(False))
    return rows.join(shared, rows.digest == shared.shared, "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("holder")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, payload) to ``folder``; their manifest, materialized."""
    dictionary = fitted_dictionary(pages)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
        part, out, name, n, size = TaskContext.get().partitionId(), None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, payload, revisit, refers_to = row
                if out is None:
                    name = files.attempt_name(part, ".warc.zst")
                    out, n = files.create(folder, name), 0
                    head = dictionary_frame(dictionary)
                    out.write(head)
                    size = len(head)
                frame = coder.compress(record(page_id, url, payload, refers_to, revisit))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(planned(pages).mapInArrow(archive, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives named in ``manifest``, checked; without ``payloads`` that column is null."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist()):
                rows, n = [], 0
                with files.read(folder, name) as stream:
                    for frame in frames(stream):
                        row = parsed(frame)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        n += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows = []
                if n != expected:
                    raise ArchiveError(f"{name} has {n} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return manifest.select("name", "records").repartition(max(1, manifest.count())).mapInArrow(records, RECORD)
