"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

Byte-pair models of this kind never merge over a blank before a word, nor between a word's letters and the symbols that end
it, so a text's ids are those of such parts in a row. Each worker keeps the ids of parts it has seen; a new part goes
through the library's own normalizer, pre-tokenizer and model. Texts for which cutting isn't safe, and texts that hold a
special token's string, are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

_TOKENIZERS: dict = {}
_LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏЀ-ӿ"  # without U+0130, whose lower case ends in a mark
_SYMBOLS = "!-&(-/:-@\\[-`{-~"  # of ASCII, all but the apostrophe, which may begin a part of its own


class _Parts(dict):
    """The ids of parts of words, in two generations: once ``most`` are held, those not seen since the last time go."""

    def __init__(self, learn, most: int):
        super().__init__()
        self._learn, self._most, self._old = learn, most, {}

    def __missing__(self, part: str) -> bytes:
        ids = self._old.get(part)
        if ids is None:
            ids = self._learn(part)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class WordCache:
    """``ids(text)``: the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._splitter, self._model = self._tokenizer.normalizer, self._tokenizer.pre_tokenizer, self._tokenizer.model
        bytewise = len(self._plain("a b")) == 2 and self._plain(" ") != self._plain("")
        # a byte-level model's words begin with their blank, and a line feed is a token of its own; in others blanks vanish
        blank = " ?" if bytewise else ""
        parts = rf"{blank}[{_LETTERS}]++(?=[{_SYMBOLS}]*+(?:[ \n]|\Z))|[{_SYMBOLS}]++(?=[ \n]|\Z)|{blank}[^ \n]+"
        self._find = re.compile(parts + r"|[ \n]" * bytewise).findall
        # other blanks and runs of blanks, where cuts could change a byte-level model's ids
        plain = [*map(chr, range(10)), *map(chr, range(11, 32)), "\x7f", "  ", " \n", "\n ", "\n\n"] * bytewise
        other = [*map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))] * bytewise
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._unsafe = plain + special, plain + special + other
        # the usual part of a byte-level model is a blank and letters: one piece, whose bytes are written as the model's characters
        self._usual = re.compile(f" ?[{_LETTERS}]+").fullmatch if bytewise and self._normalizer is None else None
        self._written = {b: self._splitter.pre_tokenize_str(chr(b))[0][0] for b in range(32, 127)} if self._usual else {}
        self._ids = _Parts(self._learn, most).__getitem__

    def _plain(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, part: str) -> bytes:
        if self._usual is not None and part.isascii() and self._usual(part):
            return np.array([t.id for t in self._model.tokenize(part.translate(self._written))], "<u4").tobytes()
        if self._normalizer is not None:
            part = self._normalizer.normalize_str(part)
        return np.array([t.id for piece, _ in self._splitter.pre_tokenize_str(part) for t in self._model.tokenize(piece)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self._unsafe[not text.isascii()]):
            return np.array(self._plain(text), "<u4").tobytes()
        return b"".join(map(self._ids, self._find(text)))


def word_cache(path: str) -> WordCache:
    """This process's cache for a tokenizer file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCache(path)
    return _TOKENIZERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
