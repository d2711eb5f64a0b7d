"""WARC archives: round trip, revisits, and archives that break the format."""

from __future__ import annotations

import io
import random
from collections import defaultdict

import pytest
import zstandard

from shortlist.llm import warc
from shortlist.llm.warc import ArchiveError


def run(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(3)
    manifest = warc.write(df, f"file://{tmp_path}/a b")
    return warc.read(manifest, f"file://{tmp_path}/a b").collect()


def test_round_trip_and_revisits(spark, tmp_path):
    rng = random.Random(3)
    bodies = [("<p>" + "".join(rng.choices("abc é\r\n", k=rng.randint(0, 300)))).encode() for _ in range(60)]
    rows = [(i, f"http://x.example/{i}", bytes(rng.choice(bodies))) for i in range(400)]
    rows += [(1000 + i, "http://hot.example/", b"") for i in range(300)]
    got = run(spark, tmp_path, rows)
    largest = defaultdict(int)
    for i, _, b in rows:
        largest[b] = max(largest[b], i)
    want = {i: (u, len(b), warc.sha1_base32(b), None if largest[b] == i else largest[b], b) for i, u, b in rows}
    assert len(got) == len(rows)
    for r in got:
        url, n, digest, refers, body = want[r.page_id]
        assert (r.url, r.payload_bytes, r.payload_digest, r.refers_to) == (url, n, digest, refers)
        assert r.record_type == ("response" if refers is None else "revisit")
        assert r.payload == (body if refers is None else None)


def test_edge_rows(spark, tmp_path):
    rows = [(None, None, b"x"), (None, None, b"x"), (1, "http://a b/\r\nX: y", b"z"), (2, None, b"z"), (2, None, b"z"), (3, "", bytes(range(256)) * 4000)]
    got = sorted(run(spark, tmp_path, rows), key=lambda r: (r.page_id or 0, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (None, "response", None), (None, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None),
    ]
    assert got[2].url == "http://a%20b/%0D%0AX:%20y" and got[-1].payload == rows[-1][2]
    assert run(spark, tmp_path, []) == []


def archive(records, dictionary=b""):
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(coder.compress(r) for r in records)


def decoded(data):
    return [warc.parsed(f) for f in warc.frames(io.BytesIO(data))]


def test_frames_and_dictionaries():
    rng = random.Random(1)
    records = [warc.record(i, "http://x/", ("word " * rng.randint(0, 90000)).encode(), None, False) for i in range(40)]
    dictionary = zstandard.train_dictionary(1024, [f"sample {i} of some text {i * i}".encode() * 9 for i in range(900)]).as_bytes()
    for d in (b"", dictionary):
        assert [r["page_id"] for r in decoded(archive(records, d))] == list(range(40))
    packed = zstandard.compress(dictionary)  # the dictionary itself may be compressed
    body = archive(records, dictionary)[8 + len(dictionary) :]
    assert len(decoded(warc.dictionary_frame(packed) + body)) == 40


def test_broken_archives_are_refused():
    good = warc.record(1, "http://x/", b"payload", None, False)
    whole = archive([good, good])
    for data in (b"", whole[8:], whole[:-3], whole[:20], archive([good])[:8] + b"junk" * 5):
        with pytest.raises(ArchiveError):
            decoded(data)
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/0.9"),
        good.replace(b"WARC-Date", b"X-Date"),
        good.replace(b"payload", b"pbyload"),
        good.replace(b"Content-Length: 7", b"Content-Length: 8"),
        good[:-2],
        good + b"more",
        good.replace(b"WARC-Type: response", b"WARC-Type response"),
        good.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
    ):
        with pytest.raises(ArchiveError):
            decoded(archive([bad]))
