"""Whole-text token ids by public tokenizers, with worker caches.

Both classes split a text at places that no token can cross and remember the ids of the parts, so that the
library encodes a part once per worker and not once per occurrence.  The result equals the library's ids for the
whole text.  A cache keeps two generations of at most ``CACHE_PARTS`` parts: when the young one is full it becomes
the old one, and parts still in use move back, so memory is bounded and frequent parts stay.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from .common import cache_of, claim_cache

CACHE_PARTS = 200_000
MAX_PART = 64  # longer parts are encoded but not remembered


@lru_cache(maxsize=1)
def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: visible Latin-1 stands for itself, the
    other bytes for the characters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(0x100 + i) for i, b in enumerate(hidden)}}


class _Parts(dict):
    """part -> native uint32 ids as bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, part):
        ids = self.old.get(part)
        if ids is None:
            ids = array("I", self.encode(part)).tobytes()
        if len(part) <= MAX_PART:
            if len(self) >= CACHE_PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class WordBpe:
    """A ``tokenizers`` file whose pre-tokens never hold white space (``word_bpe_49k.json``).

    Parts are the pieces between white space.  A text of Latin-1 characters is lower-cased as a whole and its
    words go straight to the library's BPE model; any other text, and any with characters that could form an added
    token, is split at U+0020 only and its parts go through the library's whole chain.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = _byte_alphabet()
        self.simple = _Parts(self._encode_simple)
        self.other = _Parts(lambda part: self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _encode_simple(self, part: str) -> list[int]:
        words = (part,) if part.isalpha() else self.words(part)
        if len(words) == 1:
            return [t.id for t in self.tokenize(self._letters(words[0]))]
        ids = array("I")
        for word in words:
            ids.frombytes(self.simple[word])
        return ids

    def _letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.alphabet.__getitem__, word.encode()))

    def ids(self, text: str) -> bytes:
        """Ids of the whole text as native uint32."""
        try:
            text.encode("latin-1")
            latin = "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f\x7f\x00")
        except UnicodeEncodeError:
            latin = False
        if latin:
            return b"".join(map(self.simple.__getitem__, text.lower().split()))
        return b"".join(map(self.other.__getitem__, text.split(" ")))


class PieceBpe:
    """A ``sentencepiece`` BPE model without normalisation (``piece_bpe_32k.model``).

    Parts are the pieces between single spaces: no piece of the vocabulary has a space after another character (a
    vocabulary that has one is encoded whole).  A text with a run of spaces, a space at an end, or U+2581 in it is
    split by its runs of spaces, which belong to the part that follows.
    """

    def __init__(self, path: str):
        import re

        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = any("▁" in p.lstrip("▁") for p in vocabulary)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(vocabulary))])
        self.size = len(vocabulary)
        self.runs = re.compile(r" +[^ ]*").findall
        self.parts = _Parts(self._encode)

    def _encode(self, part: str) -> list[int]:
        return self.model.encode(part, num_threads=1)

    def units(self, text: str) -> list[str] | None:
        """Parts whose encodings, each with the model's own space in front, make up the text's; None: whole."""
        if self.whole or "▁" in text or "\x00" in text:
            return None
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        found = [run[1:] for run in self.runs(" " + text)]
        return None if found[-1] == "" else found  # a last single space has no part of its own

    def ids(self, text: str) -> bytes:
        """Ids of the whole text as uint32."""
        units = self.units(text)
        if units is None:
            return array("I", self._encode(text)).tobytes()
        return b"".join(map(self.parts.__getitem__, units))


@lru_cache(maxsize=1)
def _word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=1)
def _piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def _clear() -> None:
    _word_bpe.cache_clear()
    _piece_bpe.cache_clear()


cache_of("tokenizing", _clear)


def word_bpe(path: str) -> WordBpe:
    """One tokenizer and cache per worker."""
    claim_cache("tokenizing")
    return _word_bpe(path)


def piece_bpe(path: str) -> PieceBpe:
    """One tokenizer and cache per worker."""
    claim_cache("tokenizing")
    return _piece_bpe(path)
