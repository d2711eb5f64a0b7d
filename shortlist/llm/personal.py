"""Personal data in texts: patterns propose, checksums confirm, words nearby move the score.

``email``, ``ip``, ``card`` and ``phone`` are base kinds: a match that passes its own check is a
span whatever stands around it.  The method adds kinds of its own, which need a score of
``LEAST_SCORE``:

* ``pan``   a card number inside a longer run of digit groups, which the base pattern swallows
            whole: whole groups, an issuer's prefix and length, Luhn;
* ``iban``  a known country's length, mod-97;
* ``ssn``   three, two and four digits of an issued range, and a word that says so;
* ``tel``   a number in national form, and a word that says so.

A score is what the pattern is worth, plus what its checksum is worth, plus or minus what words
within ``BEFORE`` and ``AFTER`` code points say.  Base spans carry a score too, but never go.
Added spans overlap neither base spans nor each other; of two, the one that starts first stays,
then the kind listed first.

Defined cases: null and empty texts have no spans; a text is read whole in time linear in its
length, runs of one character included; the spans of a text do not depend on other rows, so
repeated rows repeat their spans; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "pan", "iban", "ssn", "tel")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
LEAST_SCORE = 0.5
BEFORE, AFTER = 48, 24
CARD_DIGITS, PHONE_DIGITS, TEL_DIGITS = range(14, 20), range(10, 16), range(9, 13)

# What a match is worth by its pattern, and what its confirmed checksum or range adds.
PRIOR = {"email": 0.7, "ip": 0.4, "card": 0.2, "phone": 0.5, "pan": 0.2, "iban": 0.2, "ssn": 0.1, "tel": 0.1}
CONFIRMED = {"card": 0.4, "pan": 0.4, "iban": 0.6, "ssn": 0.2, "ip": 0.1, "tel": 0.2}
NEARBY = 0.3

# Words that speak for a kind, and words that speak against every kind.
SPEAKS_FOR = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "client", "login", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "movil"},
    "iban": {"iban", "account", "bank", "bic", "swift", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
SPEAKS_FOR |= {"pan": SPEAKS_FOR["card"], "tel": SPEAKS_FOR["phone"]}
SPEAKS_AGAINST = {
    "version", "release", "isbn", "issn", "doi", "order", "invoice", "serial", "tracking", "build", "checksum",
    "commit", "sku", "page", "pages", "figure", "table", "chapter",
}

# Length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_TEL = re.compile(
    r"(?<![\w+.-])(?<![0-9][\x20./-])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9](?:[\x20./-]?[0-9]){4,10}(?![\w-]|[\x20./][0-9])"
)
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its own digits summed: a multiple of ten."""
    twice = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod_97(account: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: rest 1 of 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def issued(digits: str) -> bool:
    """Whether a card issuer gives out numbers of this prefix and length."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        digits[0] == "4" and n in (16, 19)
        or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or two == 65 or four == 6011 or 3528 <= four <= 3589)
        or n == 15 and two in (34, 37)
        or n == 14 and two in (36, 38, 39)
    )


def emails(text: str) -> Iterator[Span]:
    """The local part is read backwards from each @, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[Span]:
    """Four numbers joined by dots; a longer chain is read in fours from its left."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") >= 3:
            parts = [(m.start(), m.end()) for m in _GROUP.finditer(text, *chain.span())]
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(_at_most_255(text[a:b]) for a, b in four):
                    yield "ip", four[0][0], four[3][1]


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        digits = _only_digits(m)
        if len(digits) in CARD_DIGITS and luhn(digits):
            yield "card", *m.span()


def _only_digits(m: re.Match) -> str:
    return m[0].replace(" ", "").replace("-", "")


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if sum(c in "0123456789" for c in m[0]) in PHONE_DIGITS:
            yield "phone", *m.span()


def inner_cards(text: str) -> Iterator[Span]:
    """Card numbers made of whole groups within a run that is no card number as a whole."""
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() < CARD_DIGITS.start:
            continue
        digits = _only_digits(run)
        if len(digits) in CARD_DIGITS and luhn(digits):
            continue
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, *run.span())]
        i = 0
        while i < len(groups):
            value, j = "", i
            while j < len(groups) and len(value) + groups[j][1] - groups[j][0] < CARD_DIGITS.stop:
                value += text[slice(*groups[j])]
                j += 1
                if len(value) in CARD_DIGITS and issued(value) and luhn(value):
                    yield "pan", groups[i][0], groups[j - 1][1]
                    i = j - 1
                    break
            i += 1


def accounts(text: str) -> Iterator[Span]:
    m = _IBAN.search(text)
    while m:
        wanted = IBAN_LENGTH.get(m[0][:2], 0)
        end, seen = m.start(), 0
        while seen < wanted and end < m.end():
            seen += text[end] != " "
            end += 1
        whole = seen == wanted > 0 and not text[end : end + 1].isalnum()
        found = whole and mod_97(text[m.start() : end].replace(" ", ""))
        if found:
            yield "iban", m.start(), end
        m = _IBAN.search(text, end if found else m.start() + 1)  # a match may reach into the next account


def social_numbers(text: str) -> Iterator[Span]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()


def national_phones(text: str) -> Iterator[Span]:
    for m in _TEL.finditer(text):
        if sum(c in "0123456789" for c in m[0]) in TEL_DIGITS:
            yield "tel", *m.span()


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then kind."""
    out = [*emails(text), *addresses(text), *cards(text), *phones(text)]
    return sorted(out, key=_order)


def _order(span: tuple) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    words = set(_WORD.findall(near.lower()))
    moved = NEARBY * (bool(words & SPEAKS_FOR[kind]) - bool(words & SPEAKS_AGAINST))
    return round(min(1.0, max(0.0, PRIOR[kind] + CONFIRMED.get(kind, 0.0) + moved)), 3)


def _clear_of(taken: list[Span], found: Iterable[Span]) -> Iterator[Span]:
    """Of ``found`` in order, what overlaps neither ``taken`` nor what came before."""
    taken, i, last = sorted(taken, key=lambda s: s[1]), 0, 0
    for s in found:
        while i < len(taken) and taken[i][1] < s[2]:
            last = max(last, taken[i][2])
            i += 1
        if last <= s[1]:
            last = s[2]
            yield s


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind: kind, start, end, score."""
    text = text or ""
    base = base_spans(text)
    proposed = [*inner_cards(text), *accounts(text), *social_numbers(text), *national_phones(text)]
    proposed = [s for s in sorted(proposed, key=_order) if score(text, *s) >= LEAST_SCORE]
    return [(*s, score(text, *s)) for s in sorted([*base, *_clear_of(base, proposed)], key=_order)]


def spans(text: Column) -> Column:
    """Array of ``kind``, ``start``, ``end`` (code points, end exclusive), ``score``."""

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score")
        return pd.Series([[dict(zip(names, s)) for s in scan(t)] for t in texts])

    return of(text)
