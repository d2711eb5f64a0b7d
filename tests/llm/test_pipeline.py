"""The pipeline against brute force, stage by stage, on documents with planted cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from shortlist.llm import decontaminate, packing
from test_linededup import pieces
from test_quality import plain
from test_simhash import brute_classes, brute_print
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, kept int"


def sentence(rng, low=4, high=10):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) for _ in range(rng.randint(low, high))) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    body = lambda n: " ".join(sentence(rng) for _ in range(n))
    items = [(i, " ".join(sentence(rng) for _ in range(4))) for i in range(5)]
    passage = "\n".join(sentence(rng, 9, 10) for _ in range(7))
    short = [sentence(rng, 12, 14) for _ in range(3)]
    docs, role = [], {}

    def add(kind, text):
        d = len(docs)
        docs.append((d, text, "en", "web", len(text or ""), "x", 1))
        role[d] = kind

    for _ in range(120):
        add("clean", body(rng.randint(3, 12)))
    for _ in range(12):
        add("passage", f"{body(2)}\n{passage}\n{body(2)}")
    for _ in range(6):
        add("short copy", short[0])
        add("short copy", short[1].upper().lower())
    for i in range(10):
        add("leak", f"{body(2)} {items[i % 5][1]} {body(2)}")
    for _ in range(5):
        add("junk", " ".join(f"{w}###" for w in body(4).split()))
        add("junk", sentence(rng, 5, 6) * 1)
    add("junk", None)
    add("junk", "")
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    steps = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], folder).write.parquet(f"{folder}/out{i}")
        steps.append(spark.read.parquet(f"{folder}/out{i}"))
    return folder, docs, role, items, passage, steps


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_rows_of_documents_stay(corpus):
    steps = corpus[-1]
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == before.columns
        assert set(texts(after)) <= set(texts(before))
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_rejects_junk_only(corpus):
    _, _, role, _, _, steps = corpus
    kept = set(texts(steps[1]))
    assert kept == {d for d, k in role.items() if k != "junk"}
    assert all(plain(t)[0] >= 10 for t in texts(steps[1]).values())


def test_line_dedup_leaves_each_passage_once(corpus):
    _, _, role, _, passage, steps = corpus
    before, after = texts(steps[1]), texts(steps[2])
    assert [d for d in sorted(after) if passage in after[d]] == [min(d for d, k in role.items() if k == "passage")]
    for d, t in after.items():
        if role[d] == "clean":
            assert t == before[d]
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())
    assert all(set(pieces(after[d])) <= set(pieces(before[d])) for d in after)


def test_near_dedup_keeps_the_first_of_each_class(corpus):
    steps = corpus[-1]
    before = texts(steps[2])
    ids = sorted(before)
    label = brute_classes([brute_print(before[d]) for d in ids])
    assert set(texts(steps[3])) == {ids[i] for i in set(label)}


def test_decontamination_drops_texts_with_items(corpus):
    _, _, role, items, _, steps = corpus
    before, after = texts(steps[3]), texts(steps[4])
    want = {
        d for d, t in before.items()
        if not any(decontaminate.align(w := decontaminate.word_hashes(i), decontaminate.word_hashes(t))[0] >= 0.5 * len(w) for _, i in items)
    }
    assert set(after) == want
    assert any(i in t for t in before.values() for _, i in items)  # line dedup left each item's first copy
    assert not any(i in t for t in after.values() for _, i in items)
    assert all(d in after for d, k in role.items() if k == "clean")


def test_packing_holds_every_token_once(corpus):
    steps = corpus[-1]
    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    pieces_of = defaultdict(list)
    for r in steps[5].collect():
        pieces_of[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = {d: [*library.encode(t, add_special_tokens=False).ids, packing.END_ID] for d, t in texts(steps[4]).items()}
    assert {d: [i for _, p in sorted(ps) for i in p] for d, ps in pieces_of.items()} == want


def test_run_gives_the_rows_of_its_stages(spark, corpus):
    folder, *_, steps = corpus
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert sum(n for _, _, n, _ in got) == sum(r.length for r in steps[5].collect())


def test_empty_and_repeated_rows(spark, tmp_path):
    t = " ".join("".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(40))
    rows = [(1, t, "en", "s", len(t)), (1, t, "en", "s", len(t)), (None, t, "en", "s", len(t)), (2, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()} in ({1}, {None})
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
    docs = spark.createDataFrame(rows[:2] + rows[3:], schema)
    kept = corpus_pipeline.STAGES[2][1](spark, docs, "").collect()
    assert sorted((r.doc_id, r.text is None) for r in kept) == [(1, False), (2, True)]


def test_words_of_the_passages_are_cut_whole(corpus):
    _, _, role, _, passage, steps = corpus
    lines = passage.split("\n")
    for d, t in texts(steps[2]).items():
        if role[d] == "passage" and passage not in t:
            assert not any(re.search(re.escape(x), t) for x in lines)


def five_word_jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("small", [32, 2])
def test_near_dedup_finds_every_edited_copy(spark, monkeypatch, small):
    from shortlist.llm import neardup

    monkeypatch.setattr(neardup, "SMALL", small)  # 2: groups take the way of large ones
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rng.choice([45, 100, 250]))]
        texts.append(w)
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for i in rng.sample(range(len(v)), rng.randint(0, max(1, len(v) // 40))):
                v[i] = word()
            texts.append([*v, word()] if rng.random() < 0.5 else v)
    texts = [" ".join(w) for w in texts]
    label = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if label[i] != label[j] and five_word_jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()}
    assert kept == set(label) and len(kept) < len(texts) / 2


def test_near_dedup_tells_classes_in_a_common_frame_apart(spark):
    """Texts with one long frame share bands without being copies; only each one's own copy goes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    frame = [word() for _ in range(90)]
    rows = []
    for _ in range(150):
        w = frame + [word() for _ in range(14)]
        v = list(w)
        v[-1] = word()
        rows += [w, v]
    for i in range(0, 40, 2):
        assert five_word_jaccard(" ".join(rows[i]), " ".join(rows[i + 1])) >= 0.8
        assert five_word_jaccard(" ".join(rows[i]), " ".join(rows[i + 2])) < 0.8
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()}
    assert kept == set(range(0, 300, 2))


def test_blocks_link_what_single_pairs_link(spark, monkeypatch):
    from shortlist.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 3)  # several blocks of their own and mixed ones
    rng = random.Random(9)
    words = [["w%d" % rng.randrange(40) for _ in range(30)] for _ in range(4)]
    texts = [" ".join(w[: rng.randint(24, 30)]) for w in words for _ in range(6)] + ["", "a b"]
    texts = sorted(set(texts))
    label = [rng.randrange(5) for _ in texts]
    own = spark.createDataFrame([(b, i, label[i]) for b in (1, 2) for i in range(len(texts))], "bucket long, fp long, label long")
    got = {(r.a, r.b) for r in neardup._across(own, spark.createDataFrame(list(enumerate(texts)), "fp long, t string")).collect()}
    n = len(texts)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if label[i] != label[j] and neardup.jaccard(texts[i], texts[j]) >= 0.8}
    assert got == want and want


def test_near_dedup_takes_candidates_of_simhash(spark):
    """Equal and linked SimHash prints are candidates, as by all pairs; edited copies of long texts among them."""
    from shortlist.llm import neardup, simhash

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(600)]
        texts += [" ".join(w), " ".join([*w, word()]), " ".join([word(), *w])]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(neardup.sketches(F.col("t")).alias("s")).select("s.*")
    prints = {r.fp: r.print for r in rows.collect()}
    assert prints == {neardup.sketch(t)[0]: simhash.fingerprint(t, neardup.WORDS) for t in texts}
    pairs = {(r.a, r.b) for r in neardup.print_pairs(rows).collect()}
    near = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= simhash.MAX_BITS
    assert pairs and all(near(a, b) for a, b in pairs)
    label = {f: f for f in prints}
    for a, b in pairs:
        label = {f: label[a] if x == label[b] else x for f, x in label.items()}
    assert all(label[a] == label[b] for a in prints for b in prints if near(a, b))
