"""Ids of a public tokenizer, found once for each distinct stretch of text.

A text is cut where no token can cross: before each run of ASCII white space. Stretches that were met
before come from a table; new stretches of ASCII and Latin-1 letters go through the tokenizer's own merges piece by piece,
all others through the whole tokenizer. Where the tokenizer drops white space and a whole text is of such letters, it is lowered
before it is cut, so that stretches that differ by case are one. Texts that may name an added token are encoded whole, as the library does by default. The table forgets what was long not met, which changes no result.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Stretches of a generation that a worker remembers; the last generation is kept beside the current one.
REMEMBERED = 400_000
_odd_space = re.compile("[\x85\xa0  -     　]")
#: ASCII, and the letters of Latin-1: their case and normal form need no look around.
_plain = re.compile(r"[ \t-\r]*[!-~À-ÖØ-öø-ÿ]*\Z")
_plain_text = re.compile(r"[ \t-\r!-~À-ÖØ-öø-ÿ]*\Z")
#: Characters of the longest piece that is remembered.
LONG = 1000
#: How byte-level vocabularies show a byte: printable ones of Latin-1 as themselves, the others from 256 on.
_shown_alike = {*range(33, 127), *range(161, 173), *range(174, 256)}
_shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _shown_alike)}


class _Table(dict):
    def __init__(self, make):
        super().__init__()
        self.make, self.last = make, {}

    def __missing__(self, key):
        out = self.last.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > LONG:
                return out
        if len(self) >= REMEMBERED:
            self.last = dict(self)
            self.clear()
        self[key] = out
        return out


class Ids:
    """Callable: text to its ids as an array of unsigned 32-bit integers."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        #: As the library sets it: names of added tokens in a text become those tokens.
        self.given = Tokenizer.from_file(path)
        self.marks = sorted({t.content[:2] for t in self.given.get_added_tokens_decoder().values()})
        self.merges = self.whole.model
        self.keeps_space = keeps_space
        if keeps_space:
            self.stretches = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall
            self.pieces = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÿ]+| ?[0-9]+| ?[^ \t-\rA-Za-zÀ-ÿ0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall
        else:
            self.stretches = re.compile(r"[^ \t-\r]+").findall
            self.pieces = re.compile(r"[a-zà-ÿß]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zà-ÿß0-9]+").findall
        self.of_piece = _Table(self._merge)
        self.of_stretch = _Table(self._stretch)
        self.of_lowered = _Table(self._lowered)

    def _merge(self, piece: str) -> bytes:
        bare = piece.lstrip(" ")
        if bare.isascii() and bare.isalpha():
            shown = piece if bare is piece else piece.replace(" ", _shown[32])
        else:
            shown = piece.encode().decode("latin-1").translate(_shown)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def _stretch(self, s: str) -> bytes:
        if not _plain.match(s) or len(s) > LONG:
            return np.array(self.whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.pieces(s) if self.keeps_space else self.pieces(s.lower())
        return b"".join([self.of_piece[p] for p in parts])

    def _lowered(self, s: str) -> bytes:
        return self.of_piece[s] if s.isalpha() else b"".join([self.of_piece[p] for p in self.pieces(s)])

    def __call__(self, text: str) -> np.ndarray:
        if any(m in text for m in self.marks):
            return np.array(self.given.encode(text, add_special_tokens=False).ids, "<u4")
        if not self.keeps_space and _plain_text.match(text):
            return np.frombuffer(b"".join(map(self.of_lowered.__getitem__, text.lower().split())), "<u4")
        if self.keeps_space and not text.isascii() and _odd_space.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.of_stretch.__getitem__, self.stretches(text))), "<u4")


_made: dict[tuple[str, bool], Ids] = {}


def ids_of(path: str, keeps_space: bool) -> Ids:
    if (path, keeps_space) not in _made:
        _made[path, keeps_space] = Ids(path, keeps_space)
    return _made[path, keeps_space]
