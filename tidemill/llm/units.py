"""Words of texts in all scripts, their places, and runs of them."""

from __future__ import annotations

import re

import numpy as np

from .decontaminate import words_of
from .ngram_join import shingle_hashes

#: Words of a shingle.
WORDS = 5
#: Words between covered ones in a passage, at most, and words of a covered piece that count.
GAP = 10
CREDIT = 50

#: Characters of scripts without spaces (Thai to Khmer, kana, Han), and marks beyond ASCII (fixed values).
_APART = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_OUTER = "\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3004\u3008-\u3020\u3030\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_MARKS = re.compile(f"[{_OUTER}]")
_SINGLE = re.compile(f"[{_APART}]")
_WORD = re.compile(rf"[{_APART}]|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F{_OUTER}{_APART}]+")


def units_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case; in scripts without spaces each character is one, and
    marks are in none."""
    if text and not text.isascii():
        text = _SINGLE.sub(r" \g<0> ", _MARKS.sub(" ", text))
    return words_of(text)


def unit_places(text: str) -> np.ndarray:
    """The character where each of ``units_of`` begins."""
    return np.array([m.start() for m in _WORD.finditer(text)], np.int64)


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """The hash of the ``WORDS`` words from each word on; the last ones reach past the end."""
    return shingle_hashes(np.concatenate([hashes, np.zeros(WORDS - 1, np.uint64)]), WORDS)[: len(hashes)]


def covered_spans(starts: np.ndarray, passage_words: int, percent: int) -> list[tuple[int, int]]:
    """The spans [first, last) of words of one text, given the sorted words at which shared shingles start.

    Spans are all stretches from a covered piece to another, ``passage_words`` long, that are covered
    to ``percent`` with no more than ``GAP`` other words in a row; overlapping ones are joined. Of a
    piece ``CREDIT`` words count, so that a long one doesn't pay for gaps far from it.
    """
    if not len(starts):
        return []
    at = np.flatnonzero(np.append(True, np.diff(starts) > WORDS))
    begins, ends = starts[at], starts[np.append(at[1:], len(starts)) - 1] + WORDS
    gaps = np.append(0, begins[1:] - ends[:-1])
    chains = np.flatnonzero(np.append(True, gaps[1:] > GAP))
    stops = np.append(chains[1:], len(at))
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(ends[stops - 1] - begins[chains] >= passage_words):
        a, b = begins[chains[k] : stops[k]], ends[chains[k] : stops[k]]
        gain = (100 - percent) * np.minimum(b - a, CREDIT)
        loss = percent * gaps[chains[k] : stops[k]]
        loss[0] = 0
        upto = np.cumsum(gain - loss)
        best = np.maximum.accumulate(upto[::-1])[::-1]
        reach = len(a) - 1 - np.searchsorted(best[::-1], upto - gain)
        first = len(out)
        for i in np.flatnonzero(b[reach] - a >= passage_words):
            span = (int(a[i]), int(b[reach[i]]))
            if len(out) > first and span[0] < out[-1][1]:
                out[-1] = (out[-1][0], max(span[1], out[-1][1]))
            else:
                out.append(span)
    return out


def edits(a: list[int], b: list[int]) -> int:
    """The least number of words to insert, delete or replace that makes ``a`` into ``b``.

    A column of the distance table is two numbers of a bit for each word of ``a`` (differences of
    neighbours up and down), so a word of ``b`` takes a few operations on long integers.
    """
    if not a:
        return len(b)
    where: dict[int, int] = {}
    for k, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << k
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for word in b:
        same = where.get(word, 0)
        level = (((same & up) + up) ^ up) | same | down
        rise = down | (full & ~(level | up))
        fall = up & level
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(level | rise)), rise & level
    return distance
