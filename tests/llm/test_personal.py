"""Base spans against the plain patterns; added kinds, scores and the query's digests."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from shortlist.llm import personal as P
from shortlist.llm import personal_query

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    order = list(PLAIN)
    found = [(m.start(), order.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
    return [(order[k], a, b) for a, k, b in sorted(found)]


PARTS = [
    "a@b.co", "@", ".", "x", "-", "1.2.3.4", "255", "256.1", "10.0.0.1.9", "4111 1111 1111 1111", "4111-1111",
    "+1 (555) 123-4567", "+", "(", " ", "  ", "\n", "0", "00", "ü", "٣", "5555555555554444", "378282246310005", "_", "%",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 16))) for _ in range(6000)]
    texts += ["a@b@c.com", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3", "999.1.1.1.1", "+1" + "(" * 50, ""]
    for t in texts:
        assert P.base_spans(t) == plain(t), t
    some = texts[:800]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", P.spans(F.col("text")).alias("s")).collect()}
    assert got[-1] == []
    for i, t in enumerate(some):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in P.BASE] == plain(t)


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod_97("DE89370400440532013000") and not P.mod_97("DE88370400440532013000")
    rng = random.Random(9)
    for _ in range(500):
        digits = "".join(rng.choices("0123456789", k=rng.randint(1, 25)))
        assert P.luhn(digits) == plain_luhn(digits)


def kinds(text):
    return [(s[0], text[s[1] : s[2]]) for s in P.scan(text)]


def test_added_kinds():
    assert kinds("pay to DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432.") == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ]
    assert kinds("DE88370400440532013000 and DE893704004405320130001") == []
    two = "4111111111111111 5555555555554444"
    assert kinds(two) == [("pan", "4111111111111111"), ("pan", "5555555555554444")]
    assert kinds("room 12 4111111111111111") == [("pan", "4111111111111111")]
    assert kinds("her social security number is 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("123-45-6789 alone") == [] == kinds("the ssn 000-45-6789")
    assert kinds("call me: (030) 1234 5678 today") == [("tel", "(030) 1234 5678")]
    assert kinds("the numbers (030) 1234 5678 alone") == []
    assert kinds("call 1234 5678 9012 3456 78") == []


def test_words_nearby_move_the_score():
    of = lambda t: [s[3] for s in P.scan(t)]
    card = "4111111111111111"
    (plain_,), (for_,), (against,) = of(card), of(f"my credit card {card}"), of(f"order {card}")
    assert against < plain_ < for_ and for_ <= 1
    assert kinds(f"order 12 {card}") == [] and kinds(f"order card 12 {card}") == [("pan", card)]
    far = "card" + " x" * P.BEFORE + " " + card
    assert of(far) == [plain_]


def test_added_spans_overlap_nothing():
    rng = random.Random(5)
    parts = [*PARTS, "DE89 3704 0044 0532 0130 00", "4111111111111111 5555555555554444", " call ", " ssn ", "123-45-6789", "(030) 1234 5678", " bank "]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(2, 14)))
        spans = P.scan(t)
        base = [s for s in spans if s[0] in P.BASE]
        added = [s for s in spans if s[0] not in P.BASE]
        assert [s[:3] for s in base] == plain(t)
        for s in added:
            assert s[3] >= P.LEAST_SCORE
            assert all(o is s or o[2] <= s[1] or s[2] <= o[1] for o in spans), t


def test_long_runs_take_linear_time():
    began = time.time()
    for unit in ("a", "1", "1.", "1 ", "@", "a@", "+1", "+", "DE89", "123-45-6789 ", "(12) "):
        P.scan(unit * (400_000 // len(unit)))
    assert time.time() - began < 60


def test_query(spark, tmp_path):
    texts = ["none", None, "", "mail a.b@c.org, 10.0.0.1 or +1 (555) 123-4567", "ü 4111 1111 1111 1111", "ü 4111 1111 1111 1111"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, s int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in personal_query.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got[i].spans == listed
        assert got[i].n_email == listed.count("email") and got[i].n_card == listed.count("card")
        assert len(got[i].scores) == len(plain(t or "")) and got[i].n_added == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert personal_query.query(spark, str(tmp_path)).collect() == []
