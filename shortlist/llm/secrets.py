"""Secrets in texts: fixed patterns, and values in credential contexts that are hard to guess.

The patterns give spans of kind ``assign``, ``access`` and ``hex``.  Beyond them, each value
that stands where a credential would (behind a credential word and a separator, in a bearer
header, in the user part of an address) is priced: the least number of guesses over all ways
to cut it into dictionary words, dates, repeats, keyboard walks and brute-force spans, found
by dynamic programming from left to right.  A value that takes ``10 ** LEAST_GUESSES`` guesses
or more is a span of kind ``guess``; placeholders and plain words are not.

The dictionary is the vocabulary file of a public tokenizer, whose ids fall with frequency;
its path is a parameter.

Defined cases: null and empty texts have no spans; long values are priced whole, in time
linear in their length; the spans of a text do not depend on other rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
LEAST_GUESSES = 8.0
VOCABULARY = "byte_bpe_50k.json"
SPANS = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"

# Fixed patterns, with the least length of what they must match (of group 2, or of all).
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

_QUOTED = r"""(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|([^\s"'`]\S*))"""
_CONTEXTS = (
    re.compile(
        r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[ _-]?key|credentials?|login)"
        r"""["'`]?[ \t]{0,3}(?::=|=>|->|[:=]|(?ai:\bis\b))[ \t]{0,3}""" + _QUOTED
    ),
    re.compile(r"(?ai:\bbearer)[ \t]+" + _QUOTED),
    re.compile(r"://[^\s/:@]+:()()()([^\s/@]+)@"),
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "bearer", "://")
_BASE_HINTS = ("passw", "secret", "token", "api")
_TAIL = ".,;:!?)]}>\"'`"

# Letters that signs stand for, and the rows of a US keyboard.
_LEET = str.maketrans("@4301$57", "aaeoisst")
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:3[01]|[12]\d|0?[1-9])"
    r"|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)"
)
_DATE_GUESSES = math.log10(366 * 120)
_SEGMENT = math.log10(2)
_REPEAT_UNIT = 8
#: A walk of four keys or more: its first key and direction, each further key, each turn.
_WALK, _WALK_KEY, _WALK_TURN = math.log10(47 * 8), 0.1, math.log10(4)


_KEYS = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row) if c != " "}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """Direction from one key to a different neighbour."""
    if a not in _KEYS or b not in _KEYS or a == b:
        return None
    (r, k), (s, m) = _KEYS[a], _KEYS[b]
    return (s - r, m - k) if abs(s - r) <= 1 and abs(m - k) <= 1 else None


@lru_cache(maxsize=2)
def dictionary(path: str) -> tuple[dict[str, float], int]:
    """log10 of the rank of each word of a vocabulary file, and the longest word's length."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [t[1:].lower() for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t[:1] == "Ġ" and t[1:].isalpha()]
    ranks: dict[str, float] = {}
    for w in words:
        if len(w) > 2 and w.isascii():
            ranks.setdefault(w, math.log10(len(ranks) + 2))
    return ranks, max(map(len, ranks), default=0)


def _cardinality(value: str) -> int:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 16 if re.search("[A-Fa-f]", value) else 10
    sizes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33))
    return sum(n for p, n in sizes if re.search(p, value))


def _forced(value: str, ranks: dict[str, float], longest: int) -> Iterator[tuple[int, int, float]]:
    """Dictionary words and dates: start, end and log10 of their guesses, by start."""
    size, low, plain = len(value), value.lower(), value.lower().translate(_LEET)
    for i in range(size):
        for j in range(i + 3, min(size, i + longest) + 1):
            rank = ranks.get(plain[i:j])
            if rank is not None:
                part = value[i:j]
                changed = sum(x != y for x, y in zip(low[i:j], plain[i:j]))
                upper = sum(c.isupper() for c in part)
                case = 0 if not upper else _SEGMENT if upper in (1, len(part)) else math.log10(math.comb(len(part), upper) + 1)
                yield i, j, rank + case + changed * _SEGMENT
        if value[i].isdigit():
            for j in range(i + 4, min(size, i + 10) + 1):
                if _DATE.fullmatch(value, i, j):
                    yield i, j, _DATE_GUESSES if j - i > 4 else math.log10(120)


def guesses(value: str, ranks: dict[str, float], longest: int) -> float:
    """log10 of the least number of guesses over all segmentations.

    Walks and repeats of any start and end are states of the programme: of the walk that ends at
    a place its length up to four keys counts, its last direction follows from the text; a repeat
    costs its unit and how often it stands, for ten times and more as much as the value is long.
    """
    size, low = len(value), value.lower()
    char = math.log10(max(2, _cardinality(value)))
    ready = [math.inf] * (size + 1)  # a segment may start here
    brute = [math.inf] * (size + 1)  # a brute-force span ends here and may go on
    ready[0] = 0.0
    walk = [math.inf] * 5  # by length; the last one stands for four keys and more
    before = None
    run = [0] * (_REPEAT_UNIT + 1)  # by unit: characters equal to those a unit earlier
    many = [[math.inf] * unit for unit in range(_REPEAT_UNIT + 1)]  # by unit and phase: least cost before a long repeat
    unit_cost = [0.0] * (_REPEAT_UNIT + 1)
    often = math.log10(max(10, size))
    found = _forced(value, ranks, longest)
    segment = next(found, None)
    for i in range(size):
        start = ready[i] + _SEGMENT
        while segment and segment[0] == i:
            _, j, cost = segment
            ready[j] = min(ready[j], start + cost)
            segment = next(found, None)
        brute[i + 1] = min(brute[i], start) + char
        step = _step(low[i - 1], low[i]) if i else None
        turn = _WALK_TURN if before is not None and step != before else 0.0
        if step:
            walk = [math.inf, start + _WALK, walk[1] + _WALK_KEY, walk[2] + _WALK_KEY + turn, min(walk[3], walk[4]) + _WALK_KEY + turn]
        else:
            walk = [math.inf, start + _WALK, math.inf, math.inf, math.inf]
        before = step
        best = min(ready[i + 1], brute[i + 1], walk[4])
        for unit in range(1, min(_REPEAT_UNIT, i) + 1):
            if value[i] != value[i - unit]:
                run[unit] = 0
                continue
            run[unit] += 1
            if run[unit] < unit:
                continue
            if run[unit] == unit:
                unit_cost[unit] = unit * math.log10(_cardinality(value[i + 1 - unit : i + 1]))
                many[unit] = [math.inf] * unit
            times = run[unit] // unit + 1
            for t in range(2 if unit > 1 else 3, min(times, 9) + 1):
                best = min(best, ready[i + 1 - t * unit] + _SEGMENT + unit_cost[unit] + math.log10(t))
            if times >= 10:
                least = many[unit]
                least[i % unit] = min(least[i % unit], ready[i + 1 - 10 * unit])
                best = min(best, least[i % unit] + _SEGMENT + unit_cost[unit] + often)
        ready[i + 1] = best
    return ready[-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in _BASE_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def values(text: str) -> list[tuple[int, int]]:
    """Places of values in credential contexts, each once, in order."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    out = set()
    for pattern in _CONTEXTS:
        for m in pattern.finditer(text):
            group = m.lastindex
            a, b = m.span(group)
            if group == 4:
                b = a + len(text[a:b].rstrip(_TAIL))
            if b > a:
                out.add((a, b))
    return sorted(out)


def scan(text: str | None, path: str) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind: kind, start, end, log10 of the guesses that the value takes."""
    text = text or ""
    ranks, longest = dictionary(path)
    base = base_spans(text)
    out = []
    for kind, a, b in base:
        value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
        out.append((kind, a, b, guesses(value, ranks, longest)))
    for a, b in values(text):
        if not any(x <= a and b <= y for _, x, y in base):
            price = guesses(text[a:b], ranks, longest)
            if price >= LEAST_GUESSES:
                out.append(("guess", a, b, price))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(text: Column, path: str) -> Column:
    """Array of ``kind``, ``start``, ``end`` (code points, end exclusive), ``log10_guesses``."""

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "log10_guesses")
        return pd.Series([[dict(zip(names, s)) for s in scan(t, path)] for t in texts])

    return of(text)
