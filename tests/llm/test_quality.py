"""Quality rules against plain Python counts, and sketches against exact quantiles."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shortlist.llm import quality
from shortlist.llm.rows import field

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def judged(spark, rows, schema=SCHEMA):
    measured = quality.metrics(spark.createDataFrame(rows, schema))
    return quality.verdicts(measured, quality.fences(quality.sketches(measured))).withColumn("doc_id", field("doc_id")).collect()


def test_counts(spark):
    rng = random.Random(2)
    texts = ["", None, " \t\n\x0b", "a", "a\na\n\na ", "é ü x", "a b c d e", "a b c d e a b c d e", "x " * 40, "a|b #c <d>\r\n$%&*", "\U0001f600 b"]
    texts += ["".join(rng.choices(["ab ", "c\n", "d ", "# ", "e\t", "f"], k=rng.randint(1, 80))) for _ in range(200)]
    got = {r.doc_id: r for r in judged(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])}
    for i, t in enumerate(texts):
        n = plain(t)
        assert tuple(got[i][c] for c in quality.BASE) == n, repr(t)
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (got[i].kept and got[i].base_failed)


def test_buckets_cover_whole_numbers(spark):
    values = [*range(200), *(2**k + d for k in range(8, 50) for d in (-1, 0, 1))]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    b = quality.bucket(F.col("v"))
    rows = df.select("v", b.alias("b"), quality.floor_of(b).alias("f")).orderBy("v").collect()
    for r, s in zip(rows, rows[1:]):
        assert r.b <= s.b and r.f <= r.v <= r.f * 33 / 32 + 1


def test_sketches_merge_and_give_quantiles(spark):
    rng = random.Random(3)
    rows = [("en", f"s{rng.randrange(3)}", "m", int(rng.expovariate(0.01))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "lang string, source string, metric string, v long")
    sketch = df.groupBy("lang", "source", "metric", quality.bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    q = quality.quantiles(quality.merged(sketch, ["lang"]), ["lang"]).first()
    exact = sorted(r[3] for r in rows)
    assert q.n == 3000
    for percent in (10, 50):
        value = exact[-(-percent * 3000 // 100) - 1]
        assert value * 31 / 32 - 1 <= q[f"q{percent}"] <= value


def words(rng, n, low=4, high=6):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(low, high))) for _ in range(n))


def test_fences_follow_their_group(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        rows.append((i, words(rng, 40), "en", "plain"))
        rows.append((1000 + i, " ".join(f"#{w} |" for w in words(rng, 40).split()), "en", "tables"))  # its own custom
    odd = " ".join(f"{w}###" for w in words(rng, 40).split())
    rows += [(2000, odd, "en", "plain"), (2001, words(rng, 40, 14, 18), "en", "plain"), (2002, words(rng, 40), "en", "small")]
    rows += [(2003, odd, "en", "small"), (2004, words(rng, 40), None, None)]
    got = {r.doc_id: r for r in judged(spark, rows)}
    assert all(got[i].kept and got[1000 + i].kept for i in range(150))
    assert not got[2000].kept and not got[2001].kept  # unusual for their source
    assert got[2002].kept and got[2002].level == 1
    assert got[2004].kept and got[2004].level == 2


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert judged(spark, []) == []
    text = words(random.Random(1), 30)
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, "", "en", "s")]
    assert sorted(r.kept for r in judged(spark, rows)) == [False, True, True]
    wide = judged(spark, [(1, text, "en", "s", 5, "x")], SCHEMA + ", n_words int, kept string")
    assert wide[0].kept is True and wide[0].n_words == 30
