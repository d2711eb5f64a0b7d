"""Packing and token ids against the tokenizers library used plainly."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shortlist.llm import packing, tokens

public = pytest.importorskip("public_tokenizers")

TEXTS = [
    "a  b", "", "  x", " a\n\nb ", "\ta b\r\nc", "é x y", "a 's b's don't", "\n", "a \n b", "x\x1cy z", "　a b",
    "1 2  3\n4", "á ́b", "İ Σς ΑΣ ", None, "<|endoftext|> a", "a <|endoftext|>", "<|startoftext|>x",
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "<|ENDOFTEXT|> <|endoftext|", "é<|endoftext|>\n a", "a|b || c | |", "a. b, c., .d ...",
    "x.\ny, z.\n", "\x1c", "Ünder_score 12.5, 3.", "word " * 3000, "x" * 5000,
]


def plain(name):
    """The library as it comes: strings of added tokens are those tokens."""
    return Tokenizer.from_file(public.path(name))


@pytest.mark.parametrize("chunk", [tokens.CHUNK, 20])
@pytest.mark.parametrize(
    "name, make", [("byte_bpe_50k.json", tokens.byte_encoder), ("word_bpe_49k.json", tokens.word_encoder)]
)
def test_ids_are_those_of_the_library(name, make, chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    monkeypatch.setattr(tokens, "KEEP", 50)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab.,' \n|1é́\t", k=rng.randint(1, 60))) for _ in range(600)]
    texts += ["".join(rng.choices(["<|endoftext|>", "<|startoftext|>", "<|", "a b", " ", "é", "\n"], k=9)) for _ in range(200)]
    encoder, library = make(public.path(name)), plain(name)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode_all(texts)] == want
    assert [np.concatenate(list(encoder.encode(t))).tolist() for t in texts] == want


def check(spark, docs, length, most=4, parts=5):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    rows = packing.pack(df, public.path(packing.VOCABULARY), length=length, most=most).collect()
    library = plain(packing.VOCABULARY)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append((*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append((r.doc_tokens, r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, copies in want.items():
        pieces = sorted(by_doc.pop(d), key=lambda x: x[:2])
        if len(copies) == 1:
            assert np.concatenate([p[2] for p in pieces]).tolist() == list(copies[0])
            assert [p[1] for p in pieces] == np.cumsum([0, *[len(p[2]) for p in pieces[:-1]]]).tolist()
            assert {p[0] for p in pieces} == {len(copies[0])}
        else:
            assert sum(len(p[2]) for p in pieces) == sum(map(len, copies))
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)  # full, or a power of two: no padding
    return rows


def test_packing_is_whole_and_without_padding(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["one", "two", "Three,", "überlang."], k=rng.randint(0, 200)))) for i in range(150)]
    check(spark, docs, 64)
    check(spark, docs, 60, most=1)


def test_many_parts_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 3)
    check(spark, [(i, "some words here") for i in range(40)], 32, parts=20)


def test_edge_rows(spark):
    docs = [(None, "a b"), (1, None), (2, ""), (3, "x y z"), (3, "x y z"), (4, "long text " * 5000)]
    check(spark, docs, 128)
    assert check(spark, [], 128) == []


def test_best_fit_prefers_the_tightest_window():
    p = packing.Packer(10, 2)
    for n in (4, 7):
        assert list(p.place(n, 0, n, np.zeros(n, np.uint32))) == []
    assert [w.fill for w in p.place(3, 0, 3, np.zeros(3, np.uint32))] == [10]
    assert [w.fill for w in p.open] == [4]
