"""One form for text that looks the same but differs in its characters.

Code points and strings that look alike are joined into classes by union-find, transitively: width, compatibility and
joined forms, decomposed letters, letters of other scripts, spaces, hyphens, invisible characters (alike to nothing at
all). The ordinary member of a class that is most frequent in the whole corpus represents it. Texts are rewritten
greedily, longest pattern first, by a multi-pattern automaton, until nothing changes.

Letters of another script are rewritten in words of this one only: a word really written in Cyrillic or Greek stays.
Sequences garbled by a wrong decoding stay, too; they are the encoding repair's business.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema
from .charset import INVISIBLE, char_class
from .mojibake import garbled_spans, suspicious

# Letters of other scripts that look like Latin ones, each with the Latin one after it.
CROSS_SCRIPT = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϳj ϲc ɡg ɑa ıi"
).split()
# CJK radicals without a decomposition of their own, each with the character after it.
RADICALS = "⺁厂 ⺇几 ⺌小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺛旡 ⺜日 ⺝月 ⺠民 ⺢氺 ⺩王 ⺬示 ⺮竹 ⺯糸 ⺶羊 ⺷羊 ⺸羊 ⺼肉 ⻁虎 ⻄西 ⻅见 ⻆角 ⻉贝 ⻋车 ⻓长 ⻔门 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟食 ⻢马 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻬齐 ⻮齿 ⻰龙".split()
# Hyphens that look like the ordinary one. Dashes and minus signs are signs of their own.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _ordinary(text: str) -> bool:
    """Whether a look-alike may stand for text like this: letters, digits, Han characters, spaces, hyphens."""
    return all(c in " -" or c.isascii() and c.isalnum() or unicodedata.category(c) in ("Lo", "Ll", "Lu") and (unicodedata.name(c, "").startswith(("CJK UNIFIED", "LATIN"))) for c in text)


class Classes:
    """Union-find over strings of one or more code points."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b, key=lambda s: (len(s), s))] = min(a, b, key=lambda s: (len(s), s))

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


@functools.cache
def look_alikes() -> dict[str, list[str]]:
    """The classes by root. The members of the class of the empty string are invisible."""
    classes = Classes()
    for o in range(0x80, 0x30000):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        how = unicodedata.decomposition(c)
        if how and (kind in ("Ll", "Lu", "Lo", "Lm", "Nd", "Zs", "Pd") or "KANGXI RADICAL" in unicodedata.name(c, "") or "CJK RADICAL" in unicodedata.name(c, "")):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and not how.startswith(("<super>", "<sub>", "<circle>", "<square>", "<fraction>")) and _ordinary(plain):
                classes.join(c, plain)
        if how and not how.startswith("<") and unicodedata.normalize("NFC", c) == c:
            apart = unicodedata.normalize("NFD", c)
            if len(apart) > 1 and unicodedata.name(c, "").startswith("LATIN"):
                classes.join(apart, c)
                if len(apart) > 2:  # some of the marks may be joined already
                    for n in range(2, len(apart)):
                        classes.join(unicodedata.normalize("NFC", apart[:n]) + apart[n:], c)
    for other, latin in CROSS_SCRIPT:
        classes.join(other, latin)
    for radical, han in RADICALS:
        classes.join(radical, han)
    for c in INVISIBLE:
        classes.join(c, "")
    for c in SPACES:
        classes.join(c, " ")
    for c in HYPHENS:
        classes.join(c, "-")
    return classes.members()


def rules(counts: dict[str, int] | None = None) -> dict[str, str]:
    """Pattern to replacement: every member of a class to its most frequent ordinary member.

    counts: frequency by code point. Ordinary members are single code points that their normal form leaves as they
    are; the smaller code point wins a tie. Characters that are their class's representative have no rule.
    """
    counts, out = counts or {}, {}
    for root, members in look_alikes().items():
        if root == "":
            best = ""
        else:
            plain = [m for m in members if len(m) == 1 and m not in INVISIBLE and unicodedata.normalize("NFKC", m) == m and _ordinary(m)]
            plain = plain or [unicodedata.normalize("NFKC", root)]  # joined forms stand for several letters
            # a foreign letter never outvotes the ordinary one: rank by script first where a class spans scripts
            best = min(plain, key=lambda m: (m > "\x7f" and any(x <= "\x7f" for x in plain), -counts.get(m, 0), m))
        out |= {m: best for m in members if m != best and not m.isascii()}
    return out


_CYRILLIC, _GREEK = "Ѐ-ԯ", "Ͱ-Ͽ"
_WORD = re.compile(rf"[A-Za-zÀ-ɏɐ-ʯ{_CYRILLIC}{_GREEK}Ａ-Ｚａ-ｚ̀-ͯ{char_class(INVISIBLE)}]+")
_MIXED = r"[A-Za-z][\u0430-\u044f]|[\u0430-\u044f][A-Za-z]"
_FOREIGN = frozenset(x[0] for x in CROSS_SCRIPT)
_TWINS = {x[1]: x[0] for x in reversed(CROSS_SCRIPT) if "Ѐ" <= x[0] <= "ԯ"}


class Normalizer:
    def __init__(self, rule: dict[str, str]):
        import ahocorasick

        self.rule = rule
        self.automaton = ahocorasick.Automaton()
        for pattern in rule:
            self.automaton.add_word(pattern, pattern)
        self.automaton.make_automaton()
        # decomposed letters are seen by their marks; everything else by its own code point
        self.any = re.compile("[" + char_class("".join(p for p in rule if len(p) == 1)) + rf"\u0300-\u036f]|{_MIXED}")
        self.other = re.compile(rf"[{char_class(''.join(_FOREIGN))}]|{_MIXED}")

    def apply(self, text: str | None) -> tuple[str | None, int]:
        """The text in one form, and how many places were rewritten. Null and empty texts come back as they are."""
        if not text or not self.any.search(text):
            return text, 0
        keep = garbled_spans(text) if suspicious().search(text) else []
        n, stays = 0, frozenset()
        if self.other.search(text):
            text, stays, n = self._foreign_words(text)
        out, at = [], 0
        for a, b in [*keep, (len(text), len(text))]:
            new, k = self._rewrite(text[at:a], at, stays)
            out += [new, text[a:b]]
            n += k
            at = b
        return "".join(out), n

    def _foreign_words(self, text: str) -> tuple[str, frozenset[int], int]:
        """The text with Latin letters in Cyrillic words replaced, the places of letters that stay, and the count."""
        stays, swaps = set(), {}
        for m in _WORD.finditer(text):
            foreign = [c for c in m[0] if "\u0370" <= c <= "\u052f"]
            real = [c for c in foreign if c not in _FOREIGN]
            if not real:
                continue
            latin = [c for c in m[0] if c.isalpha() and not "\u0370" <= c <= "\u052f"]
            cyrillic = all("\u0400" <= c for c in real)
            if latin and not (cyrillic and all(unicodedata.normalize("NFKC", c) in _TWINS for c in latin)):
                continue
            for i, c in enumerate(m[0], m.start()):
                if c in _FOREIGN:
                    stays.add(i)
                elif c in latin:
                    swaps[i] = _TWINS[unicodedata.normalize("NFKC", c)]
                    stays.add(i)
        if swaps:
            chars = list(text)
            for i, c in swaps.items():
                chars[i] = c
            text = "".join(chars)
        return text, frozenset(stays), len(swaps)

    def _rewrite(self, text: str, offset: int, stays: frozenset[int]) -> tuple[str, int]:
        n = 0
        for turn in range(4):
            out, at, k = [], 0, 0
            for end, pattern in self.automaton.iter_long(text):
                start = end + 1 - len(pattern)
                new = self.rule[pattern]
                if not turn and start + offset in stays:
                    continue
                if new == "" and pattern in "‍‌" and start and ord(text[start - 1]) > 0x2100 and (ord(text[start - 1]) >= 0x1F000 or text[start - 1] == "\ufe0f"):
                    continue  # joins an emoji
                if turn and stays and pattern in _FOREIGN:
                    continue
                out += [text[at:start], new]
                at = end + 1
                k += 1
            if not k:
                break
            text = "".join(out) + text[at:]
            n += k
        return text, n


def char_counts(df: DataFrame, columns: tuple[str, ...]) -> dict[str, int]:
    """How often each code point occurs in the columns, over all rows; at most as many entries as Unicode has.

    Counted in each task first, so that a task sends each code point once.
    """

    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for column in batch.columns:
                text = "".join(x for x in column.to_pylist() if x)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                if points.size:
                    part = np.bincount(points)
                    total[: part.size] += part
        import pyarrow as pa

        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["point", "n"])

    picked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = picked.mapInArrow(run, "point INT, n BIGINT").groupBy("point").agg(F.sum("n").alias("n")).toArrow()
    return {chr(p): n for p, n in zip(rows["point"].to_pylist(), rows["n"].to_pylist())}


def normalize_look_alikes(df: DataFrame, key: str = "row_id", columns: tuple[str, ...] = ("chapter", "section_h2", "content")) -> DataFrame:
    """One row for each input row: key, each column in one form, and <column>_changes, the places rewritten.

    The representatives come from the frequencies over all rows. Null and empty fields stay as they are with 0 changes;
    repeated rows are treated alike; an empty table gives an empty result. Two texts that differ only in look-alikes
    come out equal.
    """
    columns = tuple(columns)
    rule = rules(char_counts(df, columns))
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]
    fields = ", ".join(f"v{i} STRING, n{i} INT" for i in range(len(columns)))

    def make():
        normalizer = Normalizer(rule)

        def run(cols):
            out = [cols[0]]
            for texts in cols[1:]:
                done = [normalizer.apply(t) for t in texts]
                out += [[d[0] for d in done], [d[1] for d in done]]
            return out

        return run

    done = map_rows(df, [key, *columns], make, schema(f"k {kind}, {fields}"))
    named = [F.col(x).alias(y) for i, c in enumerate(columns) for x, y in ((f"v{i}", c), (f"n{i}", f"{c}_changes"))]
    return done.select(F.col("k").alias(key), *named)
