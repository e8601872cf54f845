"""The reading of scanned text: one lattice over its words, for splits, merges, confusions and hyphens at once.

A text is a stream of symbols without line ends: Han characters, words, numbers and marks. Where another reading may be
right - a confusion learned from the corpus, a word of letters in two parts, two words in one, a word broken over a line
end - the lattice has a further edge with a price, minus the log of how often such noise occurs. The cheapest path under
the language model of the corpus is the reading; the search is exact (Viterbi over the last two symbols).

The model was counted over the texts that are read, noise included. So each text's own occurrence is taken off its
counts, and so are the misreadings that the usual readings of the same place let expect.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np

from .confusions import Confusion
from .hashing import mix
from .language import BACK_OFF, UNSEEN, Model, hashes
from .symbols import HAN, NUMBER, WORD, Stream, joined, stream, symbol_of, word_symbol

#: Prices of edges, beside those of confusions: a word split by a space or a line end, two words written as one, a
#: letter in a number, a stroke that only may be a hyphen, a line-end hyphen that stays, a line-end hyphen left alone.
SPLIT, MERGED, DIGIT, STROKE, COMPOUND, LEFT = 8.0, 8.0, 4.0, 3.0, 1.0, 9.0
#: The least and the highest price of a confusion, and how much cheaper than the text itself a reading must be.
CHEAPEST, DEAREST, MARGIN = 3.0, 9.0, 1.0
#: How much rarer the text must be than a reading for an edge (log ratio over three windows), before the path decides.
GATE = 2.5
#: Times the misreadings that are expected which are taken off a count.
SLACK = 3.0
#: Runs of more letters are no words; so many letters of a word may be misread; words seen more often than a share of
#: all symbols, or this number, have at most one of them misread.
LONGEST, DEPTH, SELDOM, SELDOM_SHARE = 40, 3, 20, 1e-7
#: How often a word or a pair of words must be known to be made from parts.
KNOWN, KNOWN_PAIR = 20, 3

#: Characters beside which a run of letters is only a part of a word.
_BESIDE = re.compile(r"[A-Za-z0-9_­À-ԯ​-‍⁠﻿ﬀ-ﬆ@/\\]")
_AROUND = re.compile(r"\.[A-Za-z0-9]")
_WORD = re.compile(r"[a-z0-9!|]*[a-z][a-z0-9!|]*")
_DIGITS = str.maketrans("lIOo", "1100")
_NUMERAL = re.compile(r"[lIOo0-9]*[0-9][lIOo0-9]*|[lIO]")
_POINT = re.compile(r"\.[0-9lO]|[0-9lO]\.")
_WIDE = re.compile("[！-～]+")


class Edge(NamedTuple):
    """tokens: how many symbols it stands for; out: symbols read, each with its number of letters; edit: the change."""

    tokens: int
    out: tuple[tuple[int, int], ...]
    price: float
    edit: tuple[int, int, str, str]


class Seen(NamedTuple):
    """A symbol on a path; at: its place in the stream if it is read as it stands, else -1."""

    sym: int
    letters: int
    at: int


def _narrow(text: str) -> str:
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text)


def _dressed(new: str, old: str) -> str:
    """A word in the case and the width of the one it replaces."""
    flat = _narrow(old)
    if flat.isupper() and len(flat) > 1:
        new = new.upper()
    elif flat[:1].isupper():
        new = new[:1].upper() + new[1:]
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in new) if _WIDE.fullmatch(old) else new


class Decoder:
    def __init__(self, model: Model, confusions: list[Confusion]):
        self.model = model
        self.single: dict[str, list[tuple[str, float]]] = {}
        self.double: dict[str, list[tuple[str, float]]] = {}
        letters: dict[str, list[tuple[str, float]]] = {}
        for wrong, right, rate in confusions:
            held = letters if wrong[0].isascii() else self.single if len(wrong) == 1 else self.double
            held.setdefault(wrong, []).append((right, min(DEAREST, max(CHEAPEST, -math.log(rate)))))
        self.letters = [(w, r, p) for w, x in sorted(letters.items()) for r, p in sorted(x)]
        most = max(map(len, self.single.values()), default=0)
        self.right = np.zeros((most, 0x10000), np.uint64)
        for w, x in self.single.items():
            for i, (r, _) in enumerate(x):
                self.right[i, ord(w)] = ord(r)
        self.doubles = np.array(sorted(ord(w[0]) << 16 | ord(w[1]) for w in self.double), np.uint64)
        self.plainer = {ord(w): x[0][0] for w, x in self.single.items() if not any(w in [r for r, _ in y] for y in self.single.values())}
        self.cache: dict[str, list[tuple[tuple[str, ...], float]]] = {}

    # -- edges ------------------------------------------------------------------------------------------------------

    def known(self, word: str) -> float:
        return self.model.one(1, symbol_of(word))

    def readings(self, word: str) -> list[tuple[tuple[str, ...], float]]:
        """Other readings of a word, each one or two words, with their prices; kept for each word."""
        held = self.cache.get(word)
        if held is None:
            if len(self.cache) > 1 << 17:
                self.cache.clear()
            held = self.cache[word] = self._readings(word)
        return held

    def _readings(self, word: str) -> list[tuple[tuple[str, ...], float]]:
        if not 3 <= len(word) <= LONGEST or not _WORD.fullmatch(word):
            return []
        own = max(0.0, self.known(word) - 1)
        seldom = own <= max(SELDOM, SELDOM_SHARE * self.model.total)
        best: dict[str, float] = {}
        layer = {word: 0.0}
        for _ in range(DEPTH if seldom and len(word) > 4 else 1):
            new: dict[str, float] = {}
            for w, price in layer.items():
                for wrong, right, more in self.letters:
                    at = w.find(wrong)
                    while at >= 0:
                        x = w[:at] + right + w[at + len(wrong) :]
                        if x != word and price + more < new.get(x, math.inf):
                            new[x] = price + more
                        at = w.find(wrong, at + 1)
            for x, price in new.items():
                if x.isalpha() and price < best.get(x, math.inf) and self.known(x) > max(KNOWN_PAIR, own):
                    best[x] = price
            if best:
                break
            layer = new
        out: list[tuple[tuple[str, ...], float]] = [((x,), p) for x, p in sorted(best.items())]
        if seldom and len(word) > 3 and word.isalpha():
            for i in range(1, len(word)):
                a, b = word[:i], word[i:]
                if min(len(a), len(b)) > 1 or (a if i == 1 else b) == "a":
                    if self.known(a) >= KNOWN and self.known(b) >= KNOWN and self.model.one(2, symbol_of(a), symbol_of(b)) >= KNOWN_PAIR:
                        out.append(((a, b), MERGED))
        return out

    def _single(self, s: Stream) -> np.ndarray:
        """Places of characters that a confusion would make likelier, and of confusable ones close to them."""
        out, able = np.zeros(s.sym.size, bool), np.zeros(s.sym.size, bool)
        small = np.where(s.kind == HAN, np.minimum(s.sym, np.uint64(0xFFFF)), np.uint64(0)).astype(np.int64)
        sym, n = s.sym, s.sym.size
        for right in self.right:
            at = np.nonzero(right[small])[0]
            able[at] = True
            at = at[(at >= 2) & (at < n - 2)]
            if not at.size:
                continue
            new, gain = right[small[at]], np.zeros(at.size)
            for first in (-2, -1, 0):
                old = [sym[at + first + j] for j in range(3)]
                alt = [new if first + j == 0 else sym[at + first + j] for j in range(3)]
                seen = np.maximum(self.model.counts.of(hashes(3, *old)) - 1, 0)
                gain += np.log((self.model.counts.of(hashes(3, *alt)) + 0.3) / (seen + 0.3))
            out[at[gain > GATE]] = True
        while out.any():
            near = out.copy()
            for d in (1, 2):
                near[d:] |= out[:-d]
                near[:-d] |= out[d:]
            near &= able
            if (near == out).all():
                break
            out = near | out
        return out

    def edges(self, s: Stream, breaks: list[list[tuple[int, int, str]]]) -> dict[int, list[Edge]]:
        """By place in the stream: the edges that start there."""
        out: dict[int, list[Edge]] = {}
        text, start, end = s.text, s.start, s.end
        for i in np.nonzero(self._single(s))[0].tolist():
            a, b = int(start[i]), int(end[i])
            out[i] = [Edge(1, ((ord(r), 0),), p, (a, b, r, "misread")) for r, p in self.single[text[a:b]]]
        if self.doubles.size:
            both = (s.sym[:-1] << np.uint64(16)) | s.sym[1:]
            hit = (s.kind[:-1] == HAN) & (s.kind[1:] == HAN) & np.isin(both, self.doubles)
            for i in np.nonzero(hit)[0].tolist():
                a, b = int(start[i]), int(end[i + 1])
                if b - a == 2:
                    out.setdefault(i, []).extend(Edge(2, ((ord(r), 0),), p, (a, b, r, "misread")) for r, p in self.double[text[a:b]])
        self._word_edges(s, out)
        self._split_edges(s, out)
        self._break_edges(s, breaks, out)
        return out

    def _word_edges(self, s: Stream, out: dict[int, list[Edge]]) -> None:
        words = np.nonzero(s.kind == WORD)[0]
        if not words.size:
            return
        _, first, which = np.unique(s.sym[words], return_index=True, return_inverse=True)
        text = s.text
        useful = np.zeros(first.size, bool)
        for k, i in enumerate(words[first].tolist()):
            w = _narrow(text[s.start[i] : s.end[i]])
            useful[k] = bool(_NUMERAL.fullmatch(w)) or bool(self.readings(w.lower()))
        # the same symbol may stand for capitals, which only matter for numerals
        for i in words[useful[which]].tolist():
            a, b = int(s.start[i]), int(s.end[i])
            if _BESIDE.match(text, b) or _BESIDE.match(text, a - 1):
                continue
            old = text[a:b]
            flat = _narrow(old)
            if _NUMERAL.fullmatch(flat) and (len(flat) > 1 or _POINT.match(text, b) or _POINT.match(text, a - 2)):
                out.setdefault(i, []).append(Edge(1, ((int(NUMBER), 0),), DIGIT, (a, b, _dressed(flat.translate(_DIGITS), old), "misread")))
            if _AROUND.match(text, b) or text[a - 1] == "." and _BESIDE.match(text, a - 2):
                continue
            for parts, price in self.readings(flat.lower()):
                new = _dressed(" ".join(parts), old)
                out.setdefault(i, []).append(Edge(1, tuple((symbol_of(x), len(x)) for x in parts), price, (a, b, new, "misread" if len(parts) == 1 else "")))

    def _split_edges(self, s: Stream, out: dict[int, list[Edge]]) -> None:
        at = np.nonzero((s.kind[:-1] == WORD) & (s.kind[1:] == WORD))[0]
        if not at.size:
            return
        m = self.model
        whole = m.counts.of(mix(np.full(at.size, 1, np.uint64), word_symbol(joined(s.raw[at], s.end[at] - s.start[at], s.raw[at + 1]))))
        parts = np.minimum(m.counts.of(hashes(1, s.sym[at])), m.counts.of(hashes(1, s.sym[at + 1])))
        pair = m.counts.of(hashes(2, s.sym[at], s.sym[at + 1]))
        for i in at[(whole >= KNOWN) & (parts - 1 <= 0.1 * whole) & (pair - 1 <= 0.01 * whole)].tolist():
            a, b = int(s.start[i]), int(s.end[i + 1])
            if not s.text[int(s.end[i]) : int(s.start[i + 1])].isspace():
                continue
            old = s.text[a : int(s.end[i])] + s.text[int(s.start[i + 1]) : b]
            if old.isascii() and old.isalpha():
                out.setdefault(i, []).append(Edge(2, ((symbol_of(old.lower()), len(old)),), SPLIT, (a, b, old, "")))

    def _break_edges(self, s: Stream, breaks: list[list[tuple[int, int, str]]], out: dict[int, list[Edge]]) -> None:
        """Words over line ends; those broken more than once have an edge for each number of parts."""
        text, held = s.text, {}
        for k, found in enumerate(breaks):
            for a, b, stroke in found:
                a, b = a + int(s.offset[k]), b + int(s.offset[k])
                i, j = int(np.searchsorted(s.end, a, side="right")) - 1, int(np.searchsorted(s.start, b))
                # invisible characters may stand before the stroke
                if i >= 0 and j < s.sym.size and s.kind[i] == WORD == s.kind[j] and s.start[j] == b:
                    held[i] = (a, b, stroke, j)
        for i in held:
            parts, at, price = [text[s.start[i] : s.end[i]]], i, 0.0
            begin = int(s.start[i])
            while at in held:
                a, b, stroke, j = held[at]
                parts.append(text[s.start[j] : s.end[j]])
                finish = int(s.end[j])
                soft = stroke in "—~_"
                price += STROKE if soft else 0.0
                one = "".join(parts)
                edges = out.setdefault(i, [])
                word = one.lower()
                narrow = _narrow(word)
                edges.append(Edge(j - i + 1, ((symbol_of(word), len(word)),), price, (begin, finish, one, "hyphen")))
                for reading, more in self.readings(narrow):
                    if len(reading) == 1:
                        edges.append(Edge(j - i + 1, ((symbol_of(reading[0]), len(reading[0])),), price + more, (begin, finish, _dressed(reading[0], one), "hyphen misread")))
                if len(parts) == 2 and not soft:
                    two = ((symbol_of(parts[0].lower()), len(parts[0])), (ord("-"), 0), (symbol_of(parts[1].lower()), len(parts[1])))
                    edges.append(Edge(j - i + 1, two, price + COMPOUND, (begin, finish, f"{parts[0]}-{parts[1]}", "hyphen")))
                at = j
            # the way past the break: the parts as they stand
            a, b, stroke, j = held[i]
            if stroke not in "—~_":
                out[i].append(Edge(1, ((int(s.sym[i]), int(s.end[i] - s.start[i])),), LEFT, (0, 0, "", "")))

    # -- paths ------------------------------------------------------------------------------------------------------

    def decode(self, texts: list[str], breaks: list[list[tuple[int, int, str]]], masked=None) -> list[list[tuple[int, int, str, str]]]:
        """For each text the edits (start, end, new, kinds) of its cheapest reading, in order.

        breaks: for each text the strokes at line ends between two parts of a word: start, end with the white space, the
        stroke. masked(text number, place): whether a place must be left as it is.
        """
        s = stream(texts)
        out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
        edges = self.edges(s, breaks)
        places = sorted(edges)
        at = 0
        while at < len(places):
            first, reach = places[at], places[at]
            while at < len(places) and places[at] <= reach + 2:
                reach = max(reach, places[at] + max(e.tokens for e in edges[places[at]]) - 1)
                at += 1
            k = int(s.owner[first])
            off = int(s.offset[k])
            made = [(a - off, b - off, new, kinds) for a, b, new, kinds in self._path(s, edges, first, reach + 1)]
            out[k] += [e for e in made if not masked or not masked(k, e[0])]
        return out

    def _path(self, s: Stream, edges: dict[int, list[Edge]], first: int, stop: int) -> list[tuple[int, int, str, str]]:
        """The edits of the cheapest path between two places, no edits if it isn't cheaper than the text by the margin."""
        finish = min(stop + 2, s.sym.size)
        forced = any(e.edit[3].startswith("hyphen") for i in range(first, stop) for e in edges.get(i, ()))
        stand = {i: Seen(int(s.sym[i]), int(s.end[i] - s.start[i]) if s.kind[i] == WORD else 0, i) for i in range(max(0, first - 2), finish)}
        other = [(i, i + e.tokens, e.out[0][0], math.exp(-e.price)) for i in range(first, stop) for e in edges.get(i, ()) if len(e.out) == 1 and "misread" in e.edit[3]]
        counts: dict[tuple, float] = {}

        def count(*seen: Seen) -> float:
            n = counts.get(seen)
            if n is None:
                n = counts[seen] = self._count(s, seen, other)
            return n

        def cost(a: Seen, b: Seen, c: Seen) -> float:
            m = self.model
            p = (count(c) + UNSEEN * m.unseen(c.letters)) / (m.total + UNSEEN)
            p = (count(b, c) + BACK_OFF * p) / (count(b) + BACK_OFF)
            return -math.log((count(a, b, c) + BACK_OFF * p) / (count(a, b) + BACK_OFF))

        start = (stand[first - 2], stand[first - 1])
        # place in the stream -> state -> cost, edits
        table: list[dict] = [{} for _ in range(finish - first + 1)]
        table[0][start] = (0.0, ())
        plain = (0.0, start)
        for i in range(first, finish):
            for (a, b), (price, made) in table[i - first].items():
                c = stand[i]
                stroked = any(e.price == LEFT and not e.edit[1] for e in edges.get(i, ()))
                ways = [(1, (c,), LEFT if stroked else 0.0, None)]
                ways += [(e.tokens, tuple(Seen(x, n, -1) for x, n in e.out), e.price, e.edit) for e in edges.get(i, ()) if e.edit[1]]
                for tokens, new, more, edit in ways:
                    x, y, total = a, b, price + more
                    for z in new:
                        total += cost(x, y, z)
                        x, y = y, z
                    to = table[min(i + tokens, finish) - first]
                    if (x, y) not in to or total < to[x, y][0]:
                        to[x, y] = (total, (*made, edit) if edit else made)
            a, b = plain[1]
            stroked = any(e.price == LEFT and not e.edit[1] for e in edges.get(i, ()))
            plain = (plain[0] + cost(a, b, stand[i]) + (LEFT if stroked else 0.0), (b, stand[i]))
        best, made = min(table[-1].values(), key=lambda x: x[0])
        return list(made) if made and (forced or best + MARGIN < plain[0]) else []

    def _count(self, s: Stream, seen: tuple[Seen, ...], other: list[tuple[int, int, int, float]]) -> float:
        """A count without the text's own occurrence, and without the misreadings to be expected there."""
        n = self.model.one(len(seen), *[x.sym for x in seen])
        if n <= 0 or any(x.at < 0 for x in seen):
            return n
        n -= 1.0
        i, j = seen[0].at, seen[-1].at + 1
        if j - i != len(seen):
            return max(0.0, n)
        for a, b, right, rate in other:
            if n <= 0:
                return 0.0
            if a < j and b > i:
                variant = [int(x) for x in s.sym[i : max(i, a)]] + [right] + [int(x) for x in s.sym[min(b, j) : j]]
                n -= SLACK * rate * self.model.one(len(variant), *variant)
        return max(0.0, n)
