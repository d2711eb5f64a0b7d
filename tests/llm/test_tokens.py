"""Columns of texts: ids are the library's, and repeated words and words with signs cost little."""

from __future__ import annotations

import random
import re
import sys

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from shortlist.llm import tokens

public = pytest.importorskip("public_tokenizers")
BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")


def fresh(make, path):
    make.cache_clear()
    return make(path)


@pytest.mark.parametrize("chunk", [tokens.CHUNK, 20])
@pytest.mark.parametrize("path, make", [(BYTE, tokens.byte_encoder), (WORD, tokens.word_encoder)])
def test_ids_of_a_column_are_those_of_the_library(path, make, chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    monkeypatch.setattr(tokens, "KEEP", 80)
    monkeypatch.setattr(tokens, "BATCH", 64)
    rng = random.Random(3)
    texts = [None, "", " ", "\n", " a", "a ", "\na", "a\n", "a\nb.", "\r", "a b", "a　b c", "x.\n***y!!", "ſtraße… ǅ'", "it's 'tis he'll' I'M'"]
    texts += ["".join(rng.choices("abé.,'!%$(-_ \n1²Ωœ×ʼ̈中\x00😀", k=rng.randint(1, 40))) for _ in range(1500)]
    texts += [" ".join(rng.choices(["Größe,!!", "ciónó.%%%", "\nÎle***", "a's", "b'", "é1.", "3.5.", "ǆ--", "<|", "l<|endoftext|>", "%%%", "µ.", "x" * 30 + "." * 9], k=9)) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = fresh(make, path)
    for kind in (pa.string(), pa.large_string()):
        assert [x.tolist() for x in encoder.encode_column(pa.array(["cut off", *texts], kind)[1:])] == want
    assert list(encoder.encode_column(pa.array([], pa.string()))) == []
    make.cache_clear()


def test_each_white_space_is_met():
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    odd = pc.match_substring_regex(pa.array([f"a{c}b" for c in every]), tokens.BYTE_ODD).to_pylist()
    assert [c for c, x in zip(every, odd) if x] == [c for c in every if re.search(r"[^\S \n]", c)]


def test_words_are_cut_at_letters_that_the_library_knows():
    library = Tokenizer.from_file(BYTE)
    letters = [chr(c) for c in range(0x250) if re.fullmatch(f"[{tokens._LETTERS}]", chr(c))]
    for c in letters:  # one word for the library: a space before it stays with it, a sign behind it does not
        assert len(library.pre_tokenizer.pre_tokenize_str(f" a{c}b")) == 1
        assert len(library.pre_tokenizer.pre_tokenize_str(f" {c}!?")) == 2


def test_a_repeated_word_is_looked_up_once_a_batch():
    class Counting(dict):
        asked = 0

        def get(self, *a):
            Counting.asked += 1
            return super().get(*a)

    encoder = fresh(tokens.byte_encoder, BYTE)
    encoder.known = Counting()
    list(encoder.encode_column(pa.array(["the word the word the word"] * 500)))
    assert Counting.asked == 3  # the first word of a text is another piece
    tokens.byte_encoder.cache_clear()


def test_words_go_to_the_model_alone(monkeypatch):
    encoder = fresh(tokens.byte_encoder, BYTE)
    asked, plain = [], encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda units: asked.extend(units) or plain(units))
    list(encoder.encode_column(pa.array(["ab ciónó Größe,!!\nÎle ab.\nab,!!"])))
    assert sorted("".join(asked).split("\n")) == ["", ",!!", "."]
    tokens.byte_encoder.cache_clear()
