"""Licence scan against brute force over all templates and runs of lines."""

from __future__ import annotations

import random
import re

from shortlist.llm import licenses as L
from shortlist.llm.license_texts import TEXTS, templates
from test_linededup import pieces


def brute(text):
    """First line to (license, template, dice, last line): runs of parts per template, best per first line."""
    lines = pieces(text)
    got = {}
    for key, name, body in templates():
        want = L.pairs(L.normal_words(body))
        hits = []
        for i, line in enumerate(lines):
            p = L.pairs(L.normal_words(line))
            if p & want and len(p & want) >= L.LEAST_PART * len(p):
                hits.append(i)
        runs = []
        for i in hits:
            if runs and i - runs[-1][1] <= 2:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for a, b in runs:
            p = L.pairs(L.normal_words(" ".join(lines[a : b + 1])))
            dice = round(2 * len(p & want) / (len(p) + len(want)), 6)
            if dice >= L.LEAST_DICE:
                got[a] = max(got.get(a, (0,)), (dice, b - a, key, name))
    return {a: (name, key, dice, a + n) for a, (dice, n, key, name) in got.items()}


def run(spark, rows):
    found = L.find(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {}
    for r in found.collect():
        out.setdefault(r.doc_id, {})[r.first] = (r.license, r.template, r.dice, r.last)
    return out


def corpus():
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choices("the mit general terms of by under with a file is license public".split(), k=rng.randint(2, 12))) + "."
    rows = []
    for d in range(120):
        lines = [prose() for _ in range(rng.randint(0, 5))]
        if d % 2:
            words = rng.choice(templates())[2].split()
            share = rng.choice([0, 0, 0.05, 0.3])
            words = [w if rng.random() >= share else "changed" for w in words]
            width = rng.choice([5, 12, 500])
            lines[1:1] = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
        rows.append((d, "\n".join(lines)))
    return rows


def test_found_are_those_of_brute_force(spark):
    rows = corpus()
    got = run(spark, rows)
    want = {d: b for d, t in rows if (b := brute(t))}
    assert len(want) > 30 and got == want


def test_every_template_is_found_in_a_long_text(spark):
    filler = "Some words that no template has stand here in between. " * 3000
    rows = [(i, f"{filler}\n{t}\n{filler}") for i, (_, _, t) in enumerate(templates())]
    got = run(spark, rows)
    for i, (_, name, _) in enumerate(templates()):
        assert [v[0] for v in got[i].values()] == [name] and next(iter(got[i].values()))[2] >= 0.98


def test_case_marks_and_wrapping_do_not_matter(spark):
    text = "\n".join(f"// {x}" for x in re.findall(r"(?:\S+\s*){1,9}", " ".join(TEXTS["MIT"].split())))
    assert [v[0] for v in run(spark, [(1, text)])[1].values()] == ["MIT"]


def test_edge_rows(spark):
    note = "Released under the MIT License."
    rows = [(None, note), (1, None), (2, ""), (3, note), (4, f"{note}\n\n\n\nOwn words of the author.\nMore own words.\n{note}"), (5, "license " * 9)]
    got = run(spark, rows)
    assert {k: len(v) for k, v in got.items()} == {None: 1, 3: 1, 4: 2}
    found = L.find(spark.createDataFrame([(7, note), (7, note)], "doc_id long, text string"))
    assert found.count() == 2
    assert run(spark, []) == {}
