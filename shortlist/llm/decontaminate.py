"""Benchmark passages in training texts: shared n-grams as seeds, then Smith-Waterman alignment.

Texts and test items become lower-case word sequences.  The items are a query set: they pass
through the driver in blocks of at most ``BLOCK_GRAMS`` n-grams, and each block is held
against all texts, whatever the number of blocks.

Every n-gram of an item is a seed, so a text that shares any run of ``GRAM`` words with an item
is looked at.  Around each diagonal on which seeds meet an item, the item and the passage are
aligned word by word (match 1, mismatch and gap -1); where no such passage will do, the item
is aligned with the whole text.  A text is a hit if the best alignment scores at least
``MIN_SIMILARITY`` of the item's length.  No alignment scores more than the number of item words
that its passage holds, so those that hold too few are not aligned.

A block is one scan without a shuffle of text; what leaves a task is hits.

Defined cases: null and empty texts have no hits; items with fewer than ``GRAM`` words have no
n-gram and are never reported; equal items are reported each by its own id; a text with an
item several times is reported once with its best alignment and the number of places; rows
that repeat are reported each; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 5
MIN_SIMILARITY = 0.5
BLOCK_GRAMS = 1_000_000
#: Words of a passage that are read on either side of where an item would lie, per item word.  Gaps
#: cost as much as matches bring, so an alignment that is accepted has at most this share of them.
MARGIN = 1 - MIN_SIMILARITY
CHUNK = 1 << 20

_WORD = re.compile(r"\w+")
_EDGE = re.compile(r"\W")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20

HITS = "array<struct<item_id:bigint,score:int,item_words:int,places:int,first_word:int,last_word:int>>"


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, lower case; long texts are read in pieces."""
    from xxhash import xxh64_intdigest

    parts, at, text = [], 0, text or ""
    while at < len(text):
        edge = _EDGE.search(text, at + CHUNK)
        end = edge.start() if edge else len(text)
        words = _WORD.findall(text[at:end].lower())
        parts.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * _MIX + words[k : k + n]
    return h ^ (h >> np.uint64(32))


@dataclass
class Block:
    """Items of one block with the sorted table of their n-grams."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray | None = None
    item: np.ndarray | None = None
    pos: np.ndarray | None = None
    filter: np.ndarray | None = None

    def __len__(self) -> int:
        return sum(max(0, len(w) - GRAM + 1) for w in self.words)

    def index(self) -> Block:
        """The same items with a lookup table of their n-grams."""
        at = [np.arange(max(0, len(w) - GRAM + 1)) for w in self.words]
        keys = np.concatenate([grams(w) for w in self.words] or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(at)), [len(p) for p in at])
        pos = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
        return Block(self.ids, self.words, keys[order], item[order], pos[order], seen)

    def places(self, text_grams: np.ndarray) -> np.ndarray:
        """Positions in the text whose n-gram is in the table."""
        maybe = np.flatnonzero(self.filter[text_grams >> np.uint64(64 - _FILTER_BITS)])
        spot = np.searchsorted(self.keys, text_grams[maybe])
        spot[spot == len(self.keys)] = 0
        return maybe[self.keys[spot] == text_grams[maybe]] if len(self.keys) else maybe[:0]


def blocks(items: DataFrame, most: int = BLOCK_GRAMS) -> Iterator[Block]:
    """The test items, a block at a time."""
    block = Block()
    for row in items.select("item_id", "text").toLocalIterator():
        block.ids.append(row.item_id)
        block.words.append(word_hashes(row.text))
        if len(block) >= most:
            yield block
            block = Block()
    if len(block):
        yield block


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the position in ``passage`` where it ends."""
    step = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, -1
    for word in item:
        near = np.zeros_like(row)
        near[1:] = np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1)
        row = np.maximum.accumulate(np.maximum(near, 0) + step) - step
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at - 1
    return best, end


def _traced(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Score, first and last aligned word of the passage ``b``; no score if ``b`` has too few words of ``a``."""
    if np.isin(a, b).sum() < MIN_SIMILARITY * len(a):
        return 0, 0, -1
    score, end = align(a, b)
    if end < 0:
        return 0, 0, -1
    _, back = align(a[::-1], b[end::-1])
    return score, end - back, end


@lru_cache(maxsize=4096)
def _aligned(item: bytes, passage: bytes) -> tuple[int, int, int]:
    return _traced(np.frombuffer(item, np.uint64), np.frombuffer(passage, np.uint64))


def _apart(spans: list[tuple[int, int, int]]) -> int:
    """Number of places: spans that overlap count once."""
    n, reached = 0, -1
    for _, first, last in sorted(spans, key=lambda x: x[2]):
        if first > reached:
            n, reached = n + 1, last
    return n


def find(text: str | None, block: Block) -> list[tuple]:
    """Hits of one text, in item order of the block."""
    words = word_hashes(text)
    g = grams(words)
    at = block.places(g)
    if not len(at):
        return []
    low, high = np.searchsorted(block.keys, g[at], "left"), np.searchsorted(block.keys, g[at], "right")
    place = np.repeat(at, high - low)
    entry = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
    item, diagonal = block.item[entry], place - block.pos[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    out = []
    for k in np.unique(item):
        own, w = diagonal[item == k], block.words[k]
        reach = max(GRAM, int(MARGIN * len(w)))
        cuts = np.flatnonzero(np.diff(own) > reach) + 1
        spans = []
        for group in np.split(own, cuts):
            start = max(0, int(group[0]) - reach)
            passage = words[start : max(start, int(group[-1]) + len(w) + reach)]
            score, first, last = _aligned(w.tobytes(), passage.tobytes())
            if score >= MIN_SIMILARITY * len(w):
                spans.append((score, start + first, start + last))
        if not spans:
            spans = [x for x in [_traced(w, words)] if x[0] >= MIN_SIMILARITY * len(w)]
        if spans:
            score, first, last = max(spans, key=lambda x: (x[0], -x[1]))
            out.append((block.ids[k], score, len(w), _apart(spans), first, last))
    return out


def hits(text: Column, texts: DataFrame, block: Block) -> Column:
    """Column of all hits of a text of ``texts`` with the items of a block."""
    seeds = texts.sparkSession.sparkContext.broadcast(block.index())

    @F.pandas_udf(HITS)
    def of(batch: pd.Series) -> pd.Series:
        names = ("item_id", "score", "item_words", "places", "first_word", "last_word")
        return pd.Series([[dict(zip(names, h)) for h in find(t, seeds.value)] for t in batch])

    return of(text)
