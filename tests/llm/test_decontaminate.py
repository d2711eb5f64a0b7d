"""Decontamination against full alignment of every text with every item."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.llm import decontaminate as D


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def run(spark, docs, items, most=D.BLOCK_GRAMS):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {}
    for block in D.blocks(bench, most):
        for r in df.select("doc_id", F.explode(D.hits(df.text, df, block)).alias("h")).collect():
            out[r.doc_id, r.h.item_id] = r.h
    return out


def edited(rng, w, share):
    out = []
    for x in w:
        if rng.random() < share:
            out += rng.choice([[], words(rng, 1), [x, *words(rng, 1)]])
        else:
            out.append(x)
    return out


@pytest.mark.parametrize("most", [D.BLOCK_GRAMS, 60])
def test_edited_copies_and_clean_texts(spark, most):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randint(15, 60))) for i in range(12)]
    docs, whole, edits = [], set(), set()
    for d in range(80):
        body = words(rng, rng.randint(10, 120))
        if d % 2:
            i, w = items[rng.randrange(len(items))]
            share = 0 if d % 4 == 1 else 0.08
            at = rng.randrange(len(body))
            body[at:at] = edited(rng, w, share)
            (edits if share else whole).add((d, i))
        docs.append((d, " ".join(body).title() + "."))
    got = run(spark, docs, [(i, ", ".join(w)) for i, w in items], most)
    want = set()
    for d, t in docs:
        for i, w in items:
            score, _ = D.align(D.word_hashes(" ".join(w)), D.word_hashes(t))
            if score >= D.MIN_SIMILARITY * len(w):
                want.add((d, i))
    assert whole <= set(got) <= want
    assert len(want - set(got)) <= 0.05 * len(want)  # edits so dense that no seed is left
    assert all(got[p].score == got[p].item_words for p in whole)


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert D.align(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


def test_common_passage_is_found_everywhere(spark):
    rng = random.Random(9)
    item = words(rng, 30)
    docs = [(d, " ".join([*words(rng, 5), *item, *words(rng, 5)])) for d in range(200)]
    assert set(run(spark, docs, [(1, " ".join(item))])) == {(d, 1) for d in range(200)}


def test_spans_places_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64)
    rng = random.Random(2)
    item, pad = words(rng, 20), words(rng, 300)
    text = " ".join([*pad, *item, *pad, *item])
    block = next(D.blocks(spark.createDataFrame([(4, " ".join(item))], "item_id long, text string")))
    hit = D.find(text, block.index())
    assert hit == [(4, 20, 20, 2, 300, 319)]


def test_edge_rows(spark):
    rng = random.Random(4)
    w = " ".join(words(rng, 20))
    docs = [(1, None), (2, ""), (None, w), (3, w), (3, w), (4, "a b c")]
    items = [(1, w), (2, w), (3, None), (4, ""), (5, "a b c"), (None, " ".join(words(rng, 20)))]
    got = run(spark, docs, items)
    assert set(got) == {(None, 1), (None, 2), (3, 1), (3, 2)}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


@pytest.mark.parametrize("share", [0.1, 0.2, 0.25])
def test_every_alignment_that_shares_a_gram_is_found(spark, share):
    rng = random.Random(17)
    items = [(i, words(rng, rng.randint(15, 59))) for i in range(30)]
    docs = []
    for d in range(300):
        body = words(rng, rng.randint(10, 60))
        at = rng.randrange(len(body))
        body[at:at] = edited(rng, items[d % 30][1], share)
        docs.append((d, " ".join(body)))
    got = run(spark, docs, [(i, " ".join(w)) for i, w in items])
    runs = lambda w: {tuple(w[i : i + D.GRAM]) for i in range(len(w) - D.GRAM + 1)}
    want = {}
    for d, t in docs:
        for i, w in items:
            score, _ = D.align(D.word_hashes(" ".join(w)), D.word_hashes(t))
            if score >= D.MIN_SIMILARITY * len(w) and runs(w) & runs(t.split()):
                want[d, i] = score
    assert len(want) > 100 and {p: h.score for p, h in got.items()} == want


def test_a_replaced_word_hides_no_item(spark):
    rng = random.Random(8)
    long, short = words(rng, 15), words(rng, 8)
    docs = [(1, " ".join([*long[:7], "other", *long[8:]])), (2, " ".join(["other", *short[1:]]))]
    got = run(spark, docs, [(1, " ".join(long)), (2, " ".join(short))])
    assert {p: h.score for p, h in got.items()} == {(1, 1): 13, (2, 2): 7}


def test_an_alignment_away_from_the_shared_gram(spark):
    rng = random.Random(6)
    item, pad = words(rng, 20), words(rng, 200)
    broken = [x for i, w in enumerate(item) for x in ([w] if i % 5 != 4 else ["other"])]
    docs = [(1, " ".join([*item[:5], *pad, *broken]))]
    assert run(spark, docs, [(1, " ".join(item))])[1, 1].score == 13  # 16 words match, 3 of the replaced ones lie between
