"""Texts as streams of symbols without line ends: a Han character, a word of other letters, a number or a mark is one.

All is done for a batch of texts at once, in arrays. A word's symbol is a hash that can be put together from those of
its parts, so that words that may belong together are looked up without building them.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np

from .charset import INVISIBLE
from .hashing import mix, points

#: Symbols of the place between two texts, and of any number.
GAP, NUMBER = np.uint64(0), np.uint64(1)
#: Stands between two texts while they are one array; none may hold it, see Stream.
BETWEEN = "\x01"
#: Strokes that may break a word at a line end, the soft hyphen aside, which is invisible.
HYPHENS = "-‐‑‒–¬−"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SKIP, _LETTER, _DIGIT, _MARK, _HAN, _OTHER, _GAP = range(7)


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x10000, _OTHER, np.uint8)
    for p in range(0x3400):
        c = chr(p)
        if c.isspace() or unicodedata.category(c)[0] == "C":
            out[p] = _SKIP
        elif c.isalpha():
            out[p] = _LETTER
    for c in INVISIBLE:
        out[ord(c)] = _SKIP
    for p in range(0x30, 0x3A):
        out[p] = _DIGIT
    out[[ord("!"), ord("|")]] = _MARK
    out[0x2E80:0x3400] = _OTHER
    out[0x3000] = _SKIP
    out[0x3400:0xA000] = _HAN
    out[ord(BETWEEN)] = _GAP
    return out


def folded(codes: np.ndarray) -> np.ndarray:
    """Code points with the width of wide Latin forms and the case taken out."""
    c = np.where((codes >= 0xFF01) & (codes <= 0xFF5E), codes - np.uint32(0xFEE0), codes)
    return np.where((c >= 65) & (c <= 90), c + np.uint32(32), c).astype(np.uint32)


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    """The first powers of the base, at least n."""
    return _powers(1 << max(6, int(n).bit_length()))


class Stream(NamedTuple):
    """The symbols of a batch of texts, with two gaps before, between and after them.

    sym: the symbols. start, end: their places in `text`, in which all texts stand one after the other; raw: the hash of
    a word from which those of longer words are made. owner: the text of each symbol. line: whether a line ends before it.
    offset: the place of each text in `text`.
    """

    text: str
    sym: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    line: np.ndarray
    offset: np.ndarray


def word_symbol(raw: np.ndarray) -> np.ndarray:
    return mix(np.full(np.shape(raw), 7, np.uint64), raw) | np.uint64(1 << 63)


def joined(raw_a: np.ndarray, length_a: np.ndarray, raw_b: np.ndarray) -> np.ndarray:
    """The raw hash of two words written as one."""
    length_a = np.asarray(length_a)
    return raw_a + powers(int(length_a.max()) + 1 if length_a.size else 1)[length_a] * raw_b


def raw_of(word: str) -> np.uint64:
    c = folded(points(word)).astype(np.uint64)
    return (c * powers(c.size)[: c.size]).sum(dtype=np.uint64)


@functools.lru_cache(1 << 16)
def symbol_of(unit: str) -> int:
    """The symbol of one unit given as text: a word, a number or a single character."""
    if unit.isdigit():
        return int(NUMBER)
    codes = folded(points(unit))
    if codes.size > 1 or _classes()[min(int(codes[0]), 0xFFFF)] == _LETTER:
        return int(word_symbol(np.array([raw_of(unit)]))[0])
    return int(codes[0])


def stream(texts: list[str]) -> Stream:
    held = [t.replace(BETWEEN, " ") if BETWEEN in t else t for t in texts]
    text = BETWEEN * 2 + "".join(t + BETWEEN * 2 for t in held)
    codes = folded(points(text))
    kind = _classes()[np.minimum(codes, 0xFFFF)]
    letter = kind == _LETTER
    solid = letter | (kind == _DIGIT)
    inner = np.zeros(codes.size, bool)
    # a mark counts as part of a word only between letters
    inner[1:-1] = (kind[1:-1] == _MARK) & letter[:-2] & solid[2:]
    solid |= inner
    at = np.nonzero(solid)[0]
    fresh = np.ones(at.size, bool)
    fresh[1:] = at[1:] != at[:-1] + 1
    first = np.nonzero(fresh)[0]
    begin = at[first] if at.size else at
    length = np.diff(np.append(first, at.size))
    alone = (kind == _HAN) | (kind == _OTHER) | ((kind == _MARK) & ~inner) | (kind == _GAP)
    heads = alone.copy()
    heads[begin] = True
    start = np.nonzero(heads)[0]
    sym = codes[start].astype(np.uint64)
    sym[sym == np.uint64(1)] = GAP
    raw, end = np.zeros(start.size, np.uint64), start + 1
    if at.size:
        place = np.arange(at.size) - np.repeat(first, length)
        raws = np.add.reduceat(codes[at].astype(np.uint64) * powers(int(length.max()))[place], first)
        worded = np.add.reduceat(letter[at].astype(np.int64), first) > 0
        where = np.searchsorted(start, begin)
        sym[where] = np.where(worded, word_symbol(raws), NUMBER)
        raw[where], end[where] = np.where(worded, raws, np.uint64(0)), begin + length
    sizes = np.array([len(t) + 2 for t in held], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) + 2 if held else np.zeros(0, np.int64)
    owner = np.searchsorted(offset, start, side="right") - 1
    breaks = np.cumsum(codes == 10)
    line = np.zeros(start.size, bool)
    line[1:] = breaks[start[1:]] > breaks[start[:-1]]
    shown = kind[start]
    return Stream(text, sym, raw, start, end, owner, np.where(raw > 0, _LETTER, shown), line, offset)


HAN, WORD = _HAN, _LETTER
