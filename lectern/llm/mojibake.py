"""Repair of text that was decoded with the wrong character encoding.

Round trip: the text is re-encoded under a candidate legacy encoding, stretches of the bytes that decode strictly as the
intended encoding are decoded, and a stretch is replaced when its garbling cost drops. That is repeated for nested
layers. Stretches whose bytes were lost (replacement characters, code points of unrelated scripts in a row) can't be
repaired; they are named nevertheless.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema
from .charset import INVISIBLE, clean_class, gb_han

#: One-byte encodings that text may have been read with by mistake; cp1252 stands for latin-1, too.
ONE_BYTE = ("cp1252", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866", "cp437", "cp850")
#: Multi-byte encodings that UTF-8 text may have been read with by mistake.
MULTI_BYTE = ("gb18030", "big5hkscs", "shift_jis", "euc_kr")
LAYERS = 4
#: A stretch is replaced when its cost drops by more than this.
LEAST_DROP = 0.4

UTF8_SEQUENCES = re.compile(r"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: ASCII bytes may be second halves of wrongly read characters, so a chain holds them, too.
UTF8_CHAIN = re.compile(rb"[\x40-\x7e]?(?:(?:[\xe0-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{3})+[\x40-\x7e]?)+")
UTF8_ONE = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{3}|[\x40-\x7e]")
_ODD_CASE = re.compile("[а-я][А-Я]")
HIGH_RUN = re.compile(r"[\x80-\xff]{2,}")
#: Bytes EF BF BD of replacement characters, read as Chinese once more.
LOST = re.compile("(?:锟斤拷|锟斤|斤拷锟|ï¿½)+")


@functools.cache
def suspicious() -> re.Pattern:
    """Any character that text decoded rightly doesn't hold; texts without one aren't looked at further."""
    return re.compile("[^" + clean_class() + "]|锟斤|[а-я][А-Я]")


class _Costs(dict):
    """How badly a character fits textbook text, from 0 to 4; by its script and its place in the code tables."""

    def __missing__(self, c: str) -> float:
        o, kind, name = ord(c), unicodedata.category(c), unicodedata.name(c, "")
        if 0x20 <= o < 0x7F or c in "\t\n\r" or c in gb_han(1) or c in "“”‘’—…·、。《》（），：；？！【】～":
            v = 0.0
        elif o == 0xFFFD:
            v = 4.0
        elif kind in ("Cc", "Co", "Cn", "Cs"):
            v = 3.0
        elif c in gb_han(2):
            v = 0.8
        elif name.startswith(("CJK COMPATIBILITY", "KANGXI", "FULLWIDTH")) or kind in ("Mn", "Zs") or c in INVISIBLE:
            v = 0.3
        elif name.startswith("CJK UNIFIED"):
            v = 2.0
        elif name.startswith("LATIN"):
            v = 0.5
        elif name.startswith("CYRILLIC"):
            v = 0.1 if "А" <= c <= "я" else 1.5
        elif name.startswith("GREEK"):
            v = 0.4 if 0x391 <= o <= 0x3C9 else 1.5
        elif o >= 0x1F300 or 0x2600 <= o <= 0x27BF:
            v = 0.2
        elif o < 0x100:
            v = 0.8 if c in "°±×÷½" else 1.2
        elif kind[0] in "PS":
            v = 1.2
        else:
            v = 2.0
        self[c] = v
        return v


_COSTS = _Costs()


def cost(text: str) -> float:
    return sum(map(_COSTS.__getitem__, text))


@functools.cache
def _to_bytes(encoding: str) -> dict[int, int]:
    """A str.translate table: each character to the code point of its byte in a one-byte encoding, others out of the way."""
    table = {o: 0xFFFF for o in range(0x80, 0x100)}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes((b,)).decode(encoding))] = b
        except UnicodeDecodeError:
            table[b] = b
    if encoding == "cp1252":  # browsers and programs mix it with latin-1
        table |= {b: b for b in range(0x80, 0x100)}
    return table


@functools.cache
def _high_chars(encoding: str) -> frozenset[str]:
    return frozenset(chr(c) for c, b in _to_bytes(encoding).items() if b < 0x100)


class Span(NamedTuple):
    start: int
    end: int
    text: str
    how: str


def _utf8_as_one_byte(text: str, encoding: str) -> list[Span]:
    found, view = [], text.translate(_to_bytes(encoding))
    for m in UTF8_SEQUENCES.finditer(view):
        try:
            new = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        old = text[m.start() : m.end()]
        # capital letters inside a Cyrillic word cost more than the letters show
        if cost(old) + len(_ODD_CASE.findall(old)) - cost(new) > LEAST_DROP:
            found.append(Span(m.start(), m.end(), new, f"utf-8 as {encoding}"))
    return found


def _gbk_as_one_byte(text: str, encoding: str) -> list[Span]:
    found, view = [], text.translate(_to_bytes(encoding))
    for m in HIGH_RUN.finditer(view):
        if m.end() - m.start() < 4:
            continue
        best = None
        for skip in (0, 1):
            raw = m[0][skip:].encode("latin-1")
            raw = raw[: len(raw) // 2 * 2]
            try:
                new = raw.decode("gbk")
            except UnicodeDecodeError:
                continue
            drop = cost(text[m.start() + skip : m.start() + skip + len(raw)]) - cost(new)
            if new and cost(new) < 0.5 * len(new) and drop > max(LEAST_DROP, 0.5 * len(new)) and (best is None or drop > best[0]):
                best = drop, Span(m.start() + skip, m.start() + skip + len(raw), new, f"gbk as {encoding}")
        if best:
            found.append(best[1])
    if found:  # shorter runs beside long ones belong to the same damage
        taken = [(s.start, s.end) for s in found]
        for m in HIGH_RUN.finditer(view):
            if m.end() - m.start() in (2, 3) and any(b - 12 <= m.end() and m.start() <= e + 12 for b, e in taken):
                try:
                    new = m[0][:2].encode("latin-1").decode("gbk")
                except UnicodeDecodeError:
                    continue
                if cost(new) < cost(m[0][:2]):
                    found.append(Span(m.start(), m.start() + 2, new, f"gbk as {encoding}"))
        found.sort()
    return found


def _utf8_as_multi_byte(text: str, encoding: str) -> list[Span]:
    raw, at = bytearray(), []
    for i, c in enumerate(text):
        if c < "\x80":
            b = c.encode()
        else:
            try:
                b = c.encode(encoding)
            except UnicodeEncodeError:
                b = b"\xff"
        raw += b
        at += [i] * len(b)
    at.append(len(text))
    found = []
    for m in UTF8_CHAIN.finditer(raw):
        # a chain may begin or end inside a character: whole sequences on whole characters are taken
        ends = [m.start()] + [m.start() + x.end() for x in UTF8_ONE.finditer(m[0])]
        whole = [e for e in ends if e == 0 or at[e] != at[e - 1]]
        if len(whole) < 2:
            continue
        try:
            new = raw[whole[0] : whole[-1]].decode("utf-8")
        except UnicodeDecodeError:
            continue
        start, end = at[whole[0]], at[whole[-1]]
        if text[start:end] != new and cost(text[start:end]) - cost(new) > max(1.5, 0.2 * len(new)):
            found.append(Span(start, end, new, f"utf-8 as {encoding}"))
    return found


def _gbk_as_utf8(text: str) -> list[Span]:
    """Runs without losses of code points below U+0800, such as GBK pairs give when they happen to be valid UTF-8."""
    found = []
    for m in re.finditer("[Ā-߿က-῿㐀-䷿가-힣]{2,}", text):
        try:
            new = m[0].encode("utf-8").decode("gbk")
        except UnicodeDecodeError:
            continue
        if cost(new) < 0.5 * len(new) and cost(m[0]) - cost(new) > 2:
            found.append(Span(m.start(), m.end(), new, "gbk as utf-8"))
    return found


#: What can't be decoded: lost bytes, and runs of letters of scripts that don't go together in a word.
ODD_RUN = re.compile("(?:[^" + clean_class() + "�][̀-ͯ]*){3,}")


def _beyond_repair(text: str) -> list[Span]:
    found = [Span(m.start(), m.end(), "�" * (m.end() - m.start()) if m[0][0] == "�" else "�", "lost") for m in re.finditer("�+", text)]
    found += [Span(m.start(), m.end(), "�", "lost") for m in LOST.finditer(text)]
    found += [Span(m.start(), m.end(), m[0], "unknown") for m in ODD_RUN.finditer(text) if cost(m[0]) >= 1.15 * len(m[0]) and len(set(m[0])) > 1]
    return found


def _layer(text: str) -> list[Span]:
    """Non-overlapping stretches that one round trip improves, by place; the encoding that gains most goes first."""
    gain = lambda spans: sum(cost(text[s.start : s.end]) - cost(s.text) for s in spans)
    chars = set(text)
    one_byte = [e for e in ONE_BYTE if len(_high_chars(e) & chars) > 1]
    tries = [_utf8_as_one_byte(text, e) for e in one_byte]
    if sum(1 for c in chars if c > "\u2fff" and _COSTS[c] >= 2) >= 2:
        for e in MULTI_BYTE:  # the first that helps; the tables overlap
            if found := _utf8_as_multi_byte(text, e):
                tries.append(found)
                break
    tries = sorted(((gain(t), t) for t in tries if t), key=lambda x: -x[0])
    # strict UTF-8 is much stronger evidence than pairs of GBK: those only count where it leaves most of the damage
    left = sum(1 for c in text if c > "\x7f" and not "\u2e7f" < c < "\ua000" and _COSTS[c] > 0.2)
    if not tries or sum(s.end - s.start for s in tries[0][1]) * 2 < left:
        pairs = [_gbk_as_one_byte(text, e) for e in one_byte] + [_gbk_as_utf8(text)]
        tries = sorted([*tries, *((gain(t), t) for t in pairs if t)], key=lambda x: -x[0])
    taken: list[Span] = []
    for _, spans in tries:  # the best encoding, and others only well apart from its stretches
        apart = [s for s in spans if all(s.end + 10 <= o.start or o.end + 10 <= s.start for o in taken)]
        taken += apart
    return sorted(taken)


def _scattered(text: str) -> bool:
    """Whether the only suspicious characters are single unified Han characters far apart, as misread ones are."""
    last = -9
    for m in suspicious().finditer(text):
        if len(m[0]) > 1 or not "\u4e00" <= m[0] <= "\u9fff" or m.start() - last < 3:
            return False
        last = m.start()
    return True


class Repair(NamedTuple):
    text: str | None
    spans: list[tuple[int, int]]
    how: list[str]
    layers: int
    whole: bool


def repair(text: str | None, layers: int = LAYERS) -> Repair:
    """The repaired text, the garbled stretches of the input, what was undone, and whether nothing garbled is left.

    Null, empty and clean texts come back as they are, with no stretch.
    """
    if not text or not suspicious().search(text) or _scattered(text):
        return Repair(text, [], [], 0, True)
    now, spans, how, n = text, [], [], 0
    for n in range(layers):
        found = _layer(now)
        if not n:
            spans = [(s.start, s.end) for s in found]
        if not found:
            break
        how += [x for x in dict.fromkeys(s.how for s in found) if x not in how]
        at, out = 0, []
        for s in found:
            out += [now[at : s.start], s.text]
            at = s.end
        now = "".join(out) + now[at:]
    else:
        n = layers
    lost = _beyond_repair(now)
    if lost:
        how += dict.fromkeys(s.how for s in lost)
        spans += [(s.start, s.end) for s in _beyond_repair(text)]
    return Repair(now, _joined(text, spans), how, n, not lost)


def _joined(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches grown over odd characters beside them, and joined across short gaps."""
    odd = suspicious()
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        while a and text[a - 1] > "\x7f" and (odd.match(text[a - 1]) or "\xa0" <= text[a - 1] <= "ɏ"):
            a -= 1
        while b < len(text) and text[b] > "\x7f" and (odd.match(text[b]) or "\xa0" <= text[b] <= "ɏ"):
            b += 1
        if out and a <= out[-1][1] + 4:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def garbled_spans(text: str | None) -> list[tuple[int, int]]:
    """The stretches that repair() names, from its first layer only."""
    if not text or not suspicious().search(text) or _scattered(text):
        return []
    found = [(s.start, s.end) for s in _layer(text)]
    return _joined(text, found + [(s.start, s.end) for s in _beyond_repair(text)])


def repair_encoding(df: DataFrame, key: str = "row_id", text: str = "content") -> DataFrame:
    """One row for each input row: key, garbled, layers, how, recovered, text.

    garbled says whether a sequence was garbled, recovered whether none is left after the repair (true for clean texts),
    layers how many round trips were undone, how by which encodings. Null texts stay null and count as clean, empty
    ones, too; repeated rows are treated each on their own; an empty table gives an empty result.
    """

    def make():
        def run(cols):
            out = [[] for _ in range(6)]
            for k, t in zip(*cols):
                r = repair(t)
                for o, v in zip(out, (k, bool(r.spans), r.layers, r.how, r.whole, r.text)):
                    o.append(v)
            return out

        return run

    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]
    done = map_rows(df, [key, text], make, schema(f"k {kind}, garbled BOOLEAN, layers INT, how ARRAY<STRING>, recovered BOOLEAN, text STRING"))
    return done.withColumnRenamed("k", key)
