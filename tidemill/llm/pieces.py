"""Cutting texts into the pieces that byte-level BPE merges separately.

The pattern of the public tokenizers keeps a single space with the piece after it, so a text
may be cut before each space between two non-space characters, and around line ends, without
changing any piece. Such chunks repeat a lot: their results are kept in a bounded cache.
Texts where such cuts are not safe are cut by the pattern itself, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

from .common import Recent


class _Irregular(Exception):
    pass


#: ASCII characters that are neither letters, digits nor white space (fixed values).
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Chunked:
    """Maps a text to the list of its chunks' values.

    ``of_chunk(str)`` gives the value of a whole stretch of text that starts and ends at piece
    boundaries; a text's value is made up of its chunks' values in order, which ``+`` joins.
    Marks after a letter or digit start a piece, so an unknown chunk that ends in them takes its
    value from that of the chunk without them.
    """

    def __init__(self, of_chunk: Callable[[str], object], cached: int = 400_000):
        self._whole = of_chunk
        self._first = Recent(lambda w: of_chunk(self._regular(w)), cached // 8)
        self._spaced = Recent(self._of_spaced, cached)
        self._tail = Recent(of_chunk, 10_000)
        self._newline = of_chunk("\n")

    def _of_spaced(self, word: str):
        stem = self._regular(word).rstrip(_MARKS)
        if stem and stem[-1].isalnum() and len(stem) < len(word):
            return self._spaced[stem] + self._tail[word[len(stem) :]]
        return self._whole(" " + word)

    @staticmethod
    def _regular(word: str) -> str:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return word

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if "\n\n\n" in text or text.endswith("\n\n"):
            return [self._whole(text)]
        out: list = []
        first, spaced = self._first, self._spaced.__getitem__
        try:
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append(self._newline)
                if line:
                    head, *rest = line.split(" ")
                    out.append(first[head])
                    out.extend(map(spaced, rest))
        except _Irregular:
            return [self._whole(text)]
        return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its pieces."""
    return regex.compile(pattern).findall


def special_cutter(specials: list[str]) -> Callable[[str], list[str]]:
    """A function from a text to the stretches between special strings.

    A piece never reaches across a special string, so each stretch is a text of its own; there
    is one stretch more than there are special strings.
    """
    if not specials:
        return lambda text: [text]
    return regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))).split
