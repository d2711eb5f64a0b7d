"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: a block element or line break ends a line; scripts, styles and
forms go, and so does what tags, roles or class and id words mark as boilerplate.  Each line
weighs as many characters as it has, or nothing if it is boilerplate, lies outside the
article element of a page that has one, or is mostly links.  Sums over windows of
``WINDOW`` lines surge where the text begins and dive to nothing where it ends; the lines
between a surge and its dive are kept.  In a page without an article element, runs that
hold little text next to the largest are left out.

Defined cases: null and empty pages and pages without text give an empty string; unclosed and
stray tags are mended as browsers do; text outside any tag is text; repeated rows are
extracted each; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window at which a page without an article element surges.
SURGE = 80
#: Least share of the largest run's text that another run needs in such a page.
LEAST_SHARE = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")

# Elements as the HTML standard names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea object svg math canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head title nav footer aside form menu dialog button select option fieldset".split())
# Words of class, id and role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist complementary consent contentinfo cookie cookies disqus dialog footer gdpr login masthead menu menus "
    "modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup "
    "promo promotion promotions related replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget widgets".split()
)
PAGE_HEADER = frozenset("header banner".split())


@dataclass
class Line:
    text: str
    links: int
    dropped: bool
    article: bool


@dataclass
class _Open:
    tag: str
    dropped: bool
    article: bool
    link: bool


def lines(html: str) -> Iterator[Line]:
    """The page's lines in order, with what is known about each."""
    stack = [_Open("", False, False, False)]
    parts: list[str] = []
    links = 0
    at, size = 0, len(html)

    def closed() -> Iterator[Line]:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            yield Line(text, min(links, len(text)), stack[-1].dropped, stack[-1].article)
        parts.clear()
        links = 0

    while at < size:
        m = _TOKEN.search(html, at)
        end = m.start() if m else size
        if end > at:
            parts.append(html[at:end])
            if stack[-1].link:
                links += end - at
        if not m:
            break
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag in BLOCK or place and any(o.tag in BLOCK or o.dropped != stack[place - 1].dropped for o in stack[place:]):
                yield from closed()
            if place:
                del stack[place:]
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else (size if not m["attrs"].endswith("/") else at)
            continue
        above = stack[-1]
        own = _opened(tag, m["attrs"], above)
        if tag in BLOCK or own.dropped != above.dropped:
            yield from closed()
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their kind
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag or stack[i].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body")), 0)
            if place and stack[place].tag == tag:
                del stack[place:]
                own = _opened(tag, m["attrs"], stack[-1])
        stack.append(own)
    yield from closed()


def _opened(tag: str, attrs: str, above: _Open) -> _Open:
    marks: set[str] = set()
    hidden = False
    if attrs.strip(" /"):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role"):
                marks |= set(_WORDS.findall(value.lower()))
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    dropped = above.dropped or hidden or tag in DROPPED
    if tag not in ("html", "body"):
        dropped = dropped or bool(marks & BOILERPLATE)
        if not above.article:
            dropped = dropped or tag == "header" or bool(marks & PAGE_HEADER)
    article = above.article or tag in ("article", "main") or tag not in ("html", "body") and "main" in marks
    return _Open(tag, dropped, article, above.link or tag == "a")


def weights(page: list[Line]) -> list[int]:
    """Characters that count towards the distribution, line by line."""
    has_article = any(x.article and not x.dropped for x in page)
    return [
        0 if x.dropped or (not x.article if has_article else 2 * x.links > len(x.text)) else len(x.text) for x in page
    ]


def runs(weight: list[int], least: int) -> list[tuple[int, int]]:
    """Spans from each surge to its dive: window sums reach ``least``, then fall to nothing."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    out, start = [], None
    for i, s in enumerate(sums):
        if start is None and s >= least and weight[i]:
            start = i
        elif start is not None and s == 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(weight)))
    return out


def main_lines(html: str | None) -> list[str]:
    page = list(lines(html or ""))
    weight = weights(page)
    if not any(weight):
        return []
    if any(x.article and w for x, w in zip(page, weight)):
        spans = runs(weight, 1)
    else:
        top = max(sum(weight[i : i + WINDOW]) for i in range(len(weight)))
        spans = runs(weight, min(SURGE, top))
        mass = [sum(weight[a:b]) for a, b in spans]
        spans = [s for s, m in zip(spans, mass) if m >= LEAST_SHARE * max(mass)]
    return [page[i].text for a, b in spans for i in range(a, b) if weight[i]]


def main_text(html: Column) -> Column:
    """Struct of ``text`` (lines joined by line breaks) and ``n_lines``."""

    @F.pandas_udf("text string, n_lines long")
    def of(pages: pd.Series) -> pd.DataFrame:
        kept = [main_lines(p) for p in pages]
        return pd.DataFrame({"text": ["\n".join(x) for x in kept], "n_lines": [len(x) for x in kept]})

    return of(html)
