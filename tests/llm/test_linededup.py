"""Line dedup against brute force: every sure repeat is cut, nothing but repeats is cut."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from shortlist.llm import linededup
from shortlist.llm.rows import field

BREAK = re.compile(r"""(\n|[.!?]["')\]}»’”]*[\x20\x09-\x0D])\Z""")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pieces(text):
    """A cut before each word that has a line break, or a sentence end and a blank, in front of it."""
    spots = []
    for m in re.finditer(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", text):
        before = text[: m.start()]
        blanks = before[len(before.rstrip(" \t\n\v\f\r")) :]
        if "\n" in blanks or BREAK.search(before[: len(before) - len(blanks) + 1]):
            spots.append(m.start())
    return [text[a:b] for a, b in zip([0, *spots], [*spots, len(text)])]


def run(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return linededup.dedup(df).select(field("doc_id").alias("doc_id"), field("text").alias("old"), "text", "cuts").collect()


def sentence(rng, low=3, high=12):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(low, high))) + "."


def corpus(rng):
    passages = [[sentence(rng) for _ in range(rng.randint(2, 14))] for _ in range(8)]
    passages.append([sentence(rng, 60, 70)])
    rows = []
    for d in range(90):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [sentence(rng) for _ in range(rng.randint(1, 6))]
        rows.append((d, "".join(x + rng.choice([" ", "\n"]) for x in lines)))
    return rows


def test_cuts_all_sure_repeats_and_only_repeats(spark):
    rng = random.Random(7)
    rows = corpus(rng)
    got = {r.doc_id: r for r in run(spark, rows)}
    units = {d: [" ".join(u.split()) for u in pieces(t)] for d, t in rows}
    words = {d: [len(WORD.findall(u)) for u in us] for d, us in units.items()}
    cut = {d: {i for c in got[d].cuts for i in range(c.a, c.b + 1)} for d in units}
    places = defaultdict(list)  # windows of sure and of gram length, by content
    for d, us in units.items():
        for i in range(len(us)):
            for least in (linededup.GRAM_WORDS, linededup.SURE_WORDS):
                total = 0
                for j in range(i, len(us)):
                    total += words[d][j]
                    if total >= least:
                        places[least, tuple(us[i : j + 1])].append((d, i, j))
                        break
    repeated, first = defaultdict(set), {}
    for (least, content), spots in places.items():
        first[least, content] = min(spots)
        if least == linededup.GRAM_WORDS:
            for d, i, j in sorted(spots)[1:]:
                repeated[d] |= set(range(i, j + 1))
    n_sure = n_whole = 0
    for (least, content), spots in places.items():
        if least == linededup.GRAM_WORDS:
            continue
        fd, fi, fj = first[least, content]
        grams = [k for k in places if k[0] == linededup.GRAM_WORDS and any(d == fd and fi <= i and j <= fj for d, i, j in places[k])]
        for d, i, j in sorted(spots)[1:]:
            n_sure += 1
            inside = set(range(i, j + 1)) & cut[d]
            assert sum(words[d][x] for x in inside) >= linededup.GRAM_WORDS
            if all(first[g][0] == fd and first[g][1] >= fi for g in grams):  # nothing of it is known from elsewhere
                n_whole += 1
                assert inside == set(range(i, j + 1))
    assert n_sure > 100 and n_whole > 10
    kept = {u for d, us in units.items() for i, u in enumerate(us) if i not in cut[d]}
    for d, spots in cut.items():
        for i in spots:
            assert units[d][i] in kept
            # inside a gram that repeats, or joined to one by an equal neighbour
            assert i in repeated[d] or units[d][i] in {u for us in units.values() for u in us}
        assert got[d].text == "".join(u for i, u in enumerate(pieces(got[d].old)) if i not in spots)


def test_one_line_passage_and_mid_line_passage(spark):
    rng = random.Random(1)
    passage = sentence(rng, 55, 55)
    rows = [(1, f"Own words here. {passage}"), (2, f"Other words.\n{passage}\nTail stays."), (3, passage)]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got == {1: rows[0][1], 2: "Other words.\nTail stays.", 3: ""}


def test_indents_double_blanks_and_quotes_end_lines(spark):
    rng = random.Random(11)
    lines = [sentence(rng, 9, 10) for _ in range(7)]
    for glue, lead in (("  ", "\n    "), ('" "', "\n\t\t"), (")\n   ", '"  '), ("\n \n   ", "\n\x20\x20")):
        passage = glue.join(lines)
        rows = [(i, f"{sentence(rng)}{lead}{passage}{glue}{sentence(rng)}") for i in (1, 2)]
        got = {r.doc_id: r.text for r in run(spark, rows)}
        assert got[1] == rows[0][1]
        assert not any(x.rstrip(".") in got[2] for x in lines[1:-1]), glue
    texts = ["".join(rng.choices(["a", "bc", ".", "!", "?", '"', ")", "\n", " ", "\t", "\r"], k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["." * 300000, "a." * 200000 + "b. c", "?! ... x" * 9, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", linededup.pieces(F.col("t")).alias("p")).collect():
        assert "".join(r.p) == r.t
        if r.t.strip(" \t\n\r") and len(r.t) < 1000:
            assert [p for p in r.p if p.strip()] == [p for p in pieces(r.t) if p.strip()], r.t


def test_short_repeats_and_clean_texts_stay(spark):
    rows = [(i, f"Licensed under X. Unique {i} words only here {i}.") for i in range(20)]
    assert all(r.text == r.old for r in run(spark, rows))


def test_edge_rows(spark):
    rng = random.Random(3)
    long = " ".join(sentence(rng) for _ in range(2000))
    body = " ".join(sentence(rng) for _ in range(12))
    rows = [(None, body), (5, body), (5, body), (5, None), (6, ""), (7, " \n "), (8, long), (9, long + " " + body)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[None] == [body]  # nulls come first
    assert sorted(by[5], key=str) == ["", "", None]
    assert by[6] == [""] and by[7] == [" \n "] and by[8] == [long] and by[9] == [""]


def test_hot_passage_and_self_repeat(spark):
    rng = random.Random(5)
    hot = " ".join(sentence(rng) for _ in range(10))
    rows = [(i, f"{sentence(rng)} {hot}") for i in range(300)] + [(1000, f"{hot} {sentence(rng)} {hot}")]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert sum(hot in t for t in got.values()) == 1 and hot in got[0]
    lone = sentence(rng, 30, 30) + " "
    again = run(spark, [(1, lone * 40)])[0].text
    assert again.strip() == lone.strip()


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b.", 1, "x", 2, "q")], "doc_id long, text string, th int, cuts string, id int, g string")
    assert linededup.dedup(df).select("__row.*").columns == df.columns
    assert linededup.dedup(df).select(F.col("text")).first().text == "a b."
