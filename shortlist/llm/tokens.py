"""Token ids from the vocabulary files of public tokenizers, a batch of texts at a time.

A text is cut where the tokenizer would cut it anyway, before it looks at words: between a
character that is not white space and a single space followed by another such character.  The
pieces are encoded by the library once per worker and kept, so frequent words cost a lookup.
The kept pieces are bounded: beyond ``KEEP`` those that were used once go.

A column of texts (``encode_column``) is cut in Arrow, and a piece is looked up once per batch.  A
piece that the tokenizer would cut further (line break, letters, signs) is put together from the ids
of its parts, and letters go to the vocabulary's model without the steps that find words.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 800_000
#: Texts that are looked up together, and new pieces that are encoded as one text.
BATCH = 1024
RUN = 256
CHUNK = 1 << 20

_GAP = re.compile(r"(?<=\S) (?=\S)")
_BEFORE_GAP = re.compile(r"(?<=\S)(?= \S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_REPEATED = ("  ", "\n\n", " \n", "\n ")
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")
_CASED_BY_CONTEXT = re.compile("[\u03a3\u0130]")
#: A single one of these behind a letter or digit is a token of its own.
_STOPS = ".,"
#: White space beside the space and the line break, for Arrow's expressions.
_RARE_SPACE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that ``byte_columns`` does not cut.
BYTE_ODD = rf"^$|^[ \n]|[ \n]$|[ \n][ \n]|[{_RARE_SPACE}]"
#: Letters in every version of Unicode that a tokenizer may know, and signs that are neither letters nor digits.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"\r?[{_LETTERS}]+")
_WORD_SIGNS = re.compile(f"(\r?[{_LETTERS}]+)([!-&(-/:-@[-`{{-~]{{1,8}})")


def chunks(text: str) -> Iterator[str]:
    """A long text in parts that encode alone; all but the first start with a space."""
    at = 0
    while len(text) - at > CHUNK:
        gap = _GAP.search(text, at + CHUNK)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def byte_keys(text: str) -> list[str]:
    """Pieces for byte-level vocabularies, where white space counts.

    ``word`` stands for a space and the word, ``\\nword`` for itself, ``\\rpiece`` for the piece.
    """
    if not text:
        return []
    body = text[1:] if text[0] == " " else text
    if body[:1] in " \n" or body[-1:] in " \n" or any(x in body for x in _REPEATED) or _OTHER_SPACE.search(body):
        return ["\r" + piece for piece in _BEFORE_GAP.split(text)]
    keys = body.replace("\n", " \n").split(" ")
    if body is text:
        keys[0] = "\r" + keys[0]
    return keys


def byte_columns(texts: pa.Array) -> pa.ListArray:
    """``byte_keys`` of all texts at once; none matches ``BYTE_ODD``."""
    return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\r", texts, ""), "\n", " \n"), " ")


def byte_unit(key: str) -> str:
    return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key


def byte_parts(key: str) -> tuple[str, ...]:
    """Pieces whose ids, one after the other, are those of the piece: the tokenizer cuts there."""
    if key[0] == "\n" and len(key) > 1:
        return ("\r\n", *byte_parts("\r" + key[1:]))
    if found := _WORD_SIGNS.fullmatch(key):
        return (found[1], "\r" + found[2])
    if key[-1] in _STOPS and len(key) > 1 and key[-2].isalnum():
        return (key[:-1], "\r" + key[-1])
    return (key,)


def _byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


def byte_spelled(key: str) -> str | None:
    """A word as the model sees it; nothing for pieces that are more than one word."""
    if not _WORD.fullmatch(key):
        return None
    unit = byte_unit(key)
    return codecs.charmap_decode(unit.encode(), "strict", _BYTE_LETTERS)[0]


def word_keys(text: str) -> list[str]:
    """Pieces for vocabularies that drop white space and case: the words."""
    if _CONTROL_SPACE.search(text):  # white space to Python alone
        return [text] if text else []
    return (text if _CASED_BY_CONTEXT.search(text) else text.lower()).split()


def word_parts(key: str) -> tuple[str, ...]:
    return (key[:-1], key[-1]) if key[-1] in _STOPS and len(key) > 1 and key[-2].isalnum() else (key,)


def word_spelled(key: str) -> str | None:
    return key if key.isascii() and key.isalpha() else None


class _Growing:
    """An array that is added to at the end."""

    def __init__(self, kind: type, values: np.ndarray | tuple = ()):
        self.data = np.zeros(max(1024, 2 * len(values)), kind)
        self.size = 0
        self.add(values)

    def add(self, values) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)])
        self.data[self.size : end] = values
        self.size = end


class Encoder:
    """``between`` parts pieces that are encoded in one go; it is one token, and pieces with a
    character of it are encoded singly.  ``parts`` cuts a piece further, ``spelled`` is a piece as
    the model takes it.  ``columns`` cuts texts that do not match ``odd`` like ``keys``."""

    def __init__(
        self,
        path: str,
        keys: Callable[[str], list[str]],
        unit: Callable[[str], str],
        between: str,
        parts: Callable[[str], tuple[str, ...]],
        spelled: Callable[[str], str | None],
        columns: Callable[[pa.Array], pa.ListArray] | None = None,
        odd: str = "",
    ):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # added tokens are cut out before; a piece is plain text
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: Whether a text falls apart at added tokens before anything else happens to it.
        self.apart = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(longest_first) + ")", 0 if self.apart else re.IGNORECASE)
        self.keys, self.unit, self.between, self.parts, self.spelled, self.columns = keys, unit, between, parts, spelled, columns
        self.odd = "|".join([odd, *longest_first])
        (self.mark,) = self._plain([between])[0]
        self._reset({}, np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every piece comes once

    def _reset(self, known: dict[str, int], ids: np.ndarray, size: np.ndarray) -> None:
        self.known = known
        self.flat, self.size = _Growing(np.uint32, ids), _Growing(np.int64, size)
        self.start, self.uses = _Growing(np.int64, np.cumsum(size) - size), _Growing(np.int64, np.zeros(len(size)))

    def _forget(self) -> None:
        """Keeps the pieces used more than once since the last time, unless that is most of them."""
        keep = np.flatnonzero(self.uses.data[: self.uses.size] > 1)
        if 2 * len(keep) > KEEP:
            keep = keep[:0]
        names = list(self.known)
        known = dict(zip((names[i] for i in keep.tolist()), range(len(keep))))
        self._reset(known, self._gather(keep), self.size.data[keep])

    def _gather(self, index: np.ndarray) -> np.ndarray:
        """Ids of the pieces ``index``, one after the other."""
        size = self.size.data[index]
        ends = np.cumsum(size)
        return self.flat.data[np.repeat(self.start.data[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def _plain(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_new(self, keys: list[str]) -> None:
        """Ids of pieces by the library: plain words by its model alone, others by all its steps."""
        whole = self.tokenizer.model.tokenize
        spelled = list(map(self.spelled, keys))
        words = [k for k, x in zip(keys, spelled) if x is not None]
        if words:
            ids = [[t.id for t in whole(x)] for x in spelled if x is not None]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(words, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size)
            keys = [k for k, x in zip(keys, spelled) if x is None]
        sign = self.between.strip(" ")
        units = [self.unit(k) for k in keys]
        alone = [i for i, u in enumerate(units) if sign in u]
        if alone:
            ids = self._plain([units[i] for i in alone])
            self._add([keys[i] for i in alone], np.array([x for y in ids for x in y], np.uint32), [len(x) for x in ids])
            kept = sorted(set(range(len(units))).difference(alone))
            keys, units = [keys[i] for i in kept], [units[i] for i in kept]
        if units:
            runs = [self.between.join(units[at : at + RUN]) for at in range(0, len(units), RUN)]
            ids = np.array([x for run in self._plain(runs) for x in (*run, self.mark)], np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            self._add(keys, ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)

    def _learn(self, new: list[str]) -> None:
        plain, joined, parts = [], [], []
        for k, cut in zip(new, map(self.parts, new)):
            if len(cut) == 1:
                plain.append(k)
            else:
                joined.append(k)
                parts.append(cut)
        inner = {p for p in chain.from_iterable(parts) if p not in self.known}.difference(plain)
        self._encode_new(plain + list(inner))
        if joined:
            index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64)
            ends = np.cumsum(self.size.data[index])[np.cumsum(list(map(len, parts))) - 1]
            self._add(joined, self._gather(index), np.diff(ends, prepend=0))

    def _add(self, keys: list[str], ids: np.ndarray, size: np.ndarray | list[int]) -> None:
        size = np.asarray(size, np.int64)
        self.start.add(self.flat.size + np.cumsum(size) - size)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        self.flat.add(ids)
        self.size.add(size)
        self.uses.add(np.zeros(len(keys), np.int64))

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """Ids of one text, in parts.  Strings of added tokens are those tokens, as in the library."""
        if not text or not self.added or not self.cuts.search(text):
            for chunk in chunks(text or ""):
                yield from self._encode([self.keys(chunk)])
        elif not self.apart:
            self.tokenizer.encode_special_tokens = False
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            self.tokenizer.encode_special_tokens = True
            yield np.array(ids, np.uint32)
        else:
            for part in filter(None, self.cuts.split(text)):
                if part in self.added:
                    yield np.array([self.added[part]], np.uint32)
                else:
                    yield from self.encode(part)

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, as one array each."""
        for at in range(0, len(texts), BATCH):
            part = [t or "" for t in texts[at : at + BATCH]]
            if sum(map(len, part)) > 16 * CHUNK or any(map(self.cuts.search, part)) and self.added:
                for t in part:
                    yield np.concatenate(list(self.encode(t)))
            else:
                yield from self._encode([self.keys(t) for t in part])

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``encode_all`` of a column."""
        if len(texts) > BATCH or len(texts) > 1 and texts.nbytes > 16 * CHUNK:
            half = len(texts) // 2
            yield from self.encode_column(texts[:half])
            yield from self.encode_column(texts[half:])
        elif self.columns is None or texts.nbytes > 16 * CHUNK:
            yield from self.encode_all(texts.to_pylist())
        else:
            texts = pc.fill_null(texts.cast(pa.string()), "")
            odd = pc.match_substring_regex(texts, self.odd)
            even, rest = iter(self._encode_cut(texts.filter(pc.invert(odd)))), self.encode_all(texts.filter(odd).to_pylist())
            for is_odd in odd.to_pylist():
                yield next(rest if is_odd else even)

    def _encode(self, keys: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > KEEP:
            self._forget()
        every = list(chain.from_iterable(keys))
        index = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            names = [every[i] for i in missing.tolist()]
            self._learn(list(set(names)))
            index[missing] = [self.known[k] for k in names]
        self.uses.data[: self.uses.size] += np.bincount(index, minlength=self.uses.size)
        return self._by_text(index, list(map(len, keys)))

    def _encode_cut(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > KEEP:
            self._forget()
        keys = self.columns(texts)
        pieces = pc.dictionary_encode(keys.flatten())
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            self._learn(new)
            index[missing] = [self.known[k] for k in new]
        at = pieces.indices.to_numpy()
        self.uses.data[index] += np.bincount(at, minlength=len(names))
        return self._by_text(index[at], pc.list_value_length(keys).to_pylist())

    def _by_text(self, index: np.ndarray, pieces: list[int]) -> list[np.ndarray]:
        """Ids of the pieces ``index``, cut into texts of so many pieces."""
        ids = self._gather(index)
        ends = np.r_[0, np.cumsum(self.size.data[index])]
        cuts = ends[np.cumsum([0, *pieces])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> Encoder:
    return Encoder(path, byte_keys, byte_unit, "\n", byte_parts, byte_spelled, byte_columns, BYTE_ODD)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> Encoder:
    return Encoder(path, word_keys, lambda k: k, " | ", word_parts, word_spelled)
