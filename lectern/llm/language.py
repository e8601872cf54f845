"""A language model over symbols: counts of one to three symbols in a row, and of those at line ends, with back-off."""

from __future__ import annotations

import math

import numpy as np

from .hashing import UNIT, Counts, add, buckets, mix
from .symbols import HAN, HYPHENS, WORD, Stream

BITS, PLACE_BITS = 22, 21
#: Weight of the shorter context against what was seen in the longer one.
BACK_OFF = 4.0
#: Share of all symbols left to symbols never seen, and how many of them there are: Han characters, or letters a place.
UNSEEN, CHARACTERS, LETTERS = 1.0, 20_000, 27
_START, _START_TWO, _END, _END_TWO = 31, 32, 33, 34
_HYPHENS = np.array([ord(c) for c in HYPHENS], np.uint64)


def hashes(n: int, *syms: np.ndarray) -> np.ndarray:
    h = np.full(syms[0].shape, n, np.uint64)
    for s in syms:
        h = mix(h, s)
    return h


def count_stream(s: Stream, weight: np.ndarray, table: np.ndarray, places: np.ndarray | None, place_hashes) -> None:
    """Add a batch of texts, each with its weight, to the flat tables of counts and of places."""
    sym, w = s.sym, weight[np.maximum(s.owner, 0)]
    if sym.size < 3:
        return
    # words broken over a line end, and what is beside them, teach nothing
    torn = np.zeros(sym.size, bool)
    at = np.nonzero(s.line[2:] & np.isin(sym[1:-1], _HYPHENS) & (s.kind[2:] == WORD) & (s.kind[:-2] == WORD))[0]
    for d in range(3):
        torn[at + d] = True
    whole = w * ~torn
    add(table, hashes(1, sym), BITS, whole)
    whole = np.minimum(whole[1:], whole[:-1])
    add(table, hashes(2, sym[:-1], sym[1:]), BITS, whole)
    add(table, hashes(3, sym[:-2], sym[1:-1], sym[2:]), BITS, np.minimum(whole[1:], whole[:-1]))
    # a text ends with a line as well
    begins = s.line | np.concatenate([[False], (sym[:-1] == 0) & (sym[1:] != 0)])
    ends = np.concatenate([s.line[1:] | (sym[1:] == 0) & (sym[:-1] != 0), [False]])
    at = np.nonzero(begins[:-1])[0]
    add(table, hashes(_START, sym[at]), BITS, w[at])
    add(table, hashes(_START_TWO, sym[at], sym[at + 1]), BITS, w[at])
    at = np.nonzero(ends)[0]
    at = at[at > 0]
    add(table, hashes(_END, sym[at]), BITS, w[at])
    add(table, hashes(_END_TWO, sym[at - 1], sym[at]), BITS, w[at])
    table[-1] += int(w.sum())
    if places is not None:
        at = np.nonzero((s.kind == HAN) | (s.kind == WORD))[0]
        np.add.at(places, buckets(place_hashes(sym, 1)[at], PLACE_BITS), w[at])


class Model:
    """Counts and costs. table: as count_stream fills it, with the number of all symbols in one cell more at the end."""

    def __init__(self, table: np.ndarray):
        self.counts = Counts(table[:-1], BITS, UNIT)
        self.total = max(1.0, float(table[-1]) / UNIT)
        self.lines = 1.0 + 0.02 * self.total

    def one(self, n: int, *syms: int) -> float:
        h = n
        for s in syms:
            h = ((h ^ s) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        c, b = self.counts, self.counts.bits
        other = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return float(min(c.table[0][h >> (64 - b)], c.table[1][other >> (64 - b)]))

    def unseen(self, length: int) -> float:
        """The chance of one symbol never seen; length: letters of a word, 0 for a single character."""
        return 1.0 / CHARACTERS if not length else math.exp(-min(600.0, math.log(LETTERS) * length))

    def end_gain(self, a: int, b: int, c: int) -> float:
        """How much likelier a paragraph ends between b and c than that the text goes on there: a log ratio."""
        n_ab, n_b = self.one(2, a, b), self.one(1, b)
        end = self.one(_END, b) + 0.02 * BACK_OFF
        p_end = (self.one(_END_TWO, a, b) + BACK_OFF * end / (n_b + BACK_OFF)) / (n_ab + BACK_OFF)
        p_start = (self.one(_START, c) + 0.01) / self.lines
        p_c = (self.one(1, c) + 0.01) / self.total
        p_bc = (self.one(2, b, c) + BACK_OFF * p_c) / (n_b + BACK_OFF)
        p_abc = (self.one(3, a, b, c) + BACK_OFF * p_bc) / (n_ab + BACK_OFF)
        return math.log(p_end * p_start) - math.log(p_abc)
