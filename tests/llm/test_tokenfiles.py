"""Huffman-coded id files: the code against known optima, round trips, broken files."""

from __future__ import annotations

import heapq
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shortlist.llm import tokenfiles as T

public = pytest.importorskip("public_tokenizers")
PATH = public.path(T.VOCABULARY)


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def least_cost(counts, limit):
    """Cheapest full code over all sorted length assignments, by brute force."""
    w = sorted((c for c in counts if c), reverse=True)

    def go(k, low, room):
        if k == len(w):
            return 0
        return min(
            (w[k] * n + go(k + 1, n, room - 2 ** (limit - n)) for n in range(low, limit + 1) if room >= 2 ** (limit - n) * (len(w) - k) / 2 ** max(0, limit - n) and room >= 2 ** (limit - n)),
            default=10**18,
        )

    return go(0, 1, 2**limit)


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = rng.integers(0, 50, rng.integers(2, 40)) ** rng.integers(1, 5)
        lengths = T.code_lengths(counts, 40)  # no limit to speak of
        assert (lengths[counts == 0] == 0).all()
        if (counts > 0).sum() > 1:
            assert int((lengths * counts).sum()) == huffman_cost(counts.tolist())
    for _ in range(15):
        counts = 3 ** rng.integers(0, 9, 7)
        for limit in (3, 4):
            lengths = T.code_lengths(counts, limit)
            assert lengths.max() <= limit
            assert int((lengths * counts).sum()) == least_cost(counts.tolist(), limit)
    assert T.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(9, int), 3)


def test_codes_round_trip(monkeypatch):
    rng = np.random.default_rng(1)
    for n, size in ((1, 1), (5, 2), (255, 9), (256, 300), (5000, 50000), (3000, 40)):
        ids = np.minimum(rng.geometric(0.01, n) - 1, size - 1)
        code = T.Code.of(T.code_lengths(np.bincount(ids, minlength=size)))
        at, bits = code.encode(ids)
        assert code.decode(at, bits, n, T.STRIDE).tolist() == ids.tolist()
        if n > 2 * T.STRIDE:  # from the second checkpoint on
            assert code.decode(at[1:2], bits, T.STRIDE, T.STRIDE).tolist() == ids[T.STRIDE : 2 * T.STRIDE].tolist()
        used = np.flatnonzero(code.lengths)
        spelled = [format(int(code.words[i]), f"0{code.lengths[i]}b") for i in used]
        assert not any(a != b and b.startswith(a) for a in spelled[:60] for b in spelled)


def run(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    manifest = T.save(df, PATH, f"{tmp_path}/ids")
    return sorted(T.read(manifest, f"{tmp_path}/ids").collect(), key=lambda r: r.start)


def test_documents_cross_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 100)
    rng = np.random.default_rng(4)
    docs = [(d, rng.integers(0, 40, n)) for d, n in enumerate((1, 99, 100, 101, 350, 1, 49, 50, 200))]
    out = io.BytesIO()
    out.close = lambda: None
    writer = T.Writer(out, T.Code.of(T.code_lengths(np.ones(40, int))))
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    got = list(T.documents(io.BytesIO(out.getvalue())))
    assert [(d, n, c) for d, _, n, c in got] == [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in docs]
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[len(x) for _, x in docs[:-1]]]).tolist()


def test_files_hold_the_ids_in_order(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i * 7 % 501, " ".join(rng.choices(["the", "Größe", "x\n", "12", "<|endoftext|>"], k=rng.randint(0, 90)))) for i in range(300)]
    docs += [(9001, None), (9000, ""), (-4, "long word " * 4000)]
    library = Tokenizer.from_file(PATH)
    at, want = 0, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, T.END_ID]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in run(spark, tmp_path, docs)] == want


def test_edge_rows(spark, tmp_path):
    got = run(spark, tmp_path / "a", [(None, "b"), (3, "x"), (3, "x"), (3, "x y z"), (None, None)])
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (None, 1, 2), (3, 3, 2), (3, 5, 2), (3, 7, 4)]
    assert run(spark, tmp_path / "b", []) == []


def test_broken_files_are_refused():
    code = T.Code.of(T.code_lengths(np.arange(50)))
    out = io.BytesIO()
    writer = T.Writer(out, code)
    writer.add(5, np.arange(1, 50))
    writer.block()
    data = out.getvalue()
    assert list(T.documents(io.BytesIO(data))) == [(5, 0, 49, zlib.crc32(np.arange(1, 50).astype("<u4").tobytes()))]
    flipped = bytearray(data)
    flipped[-9] ^= 255
    for bad in (b"", data[1:], data[:-1], data[:20], bytes(flipped)):
        with pytest.raises((T.FileError, zlib.error)):
            list(T.documents(io.BytesIO(bad)))
