"""Cut oversized items at natural boundaries.

The separator hierarchy is section heading, blank line, line, sentence, clause, word, character. A text is first cut
recursively into atoms that fit; atoms are then packed greedily. Every piece after the first starts with the last
`overlap` characters of its predecessor, so that dropping those gives the text back exactly.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema

LIMIT = 800
OVERLAP = 50

#: A boundary lies after each match, coarse to fine.
SEPARATORS = tuple(
    re.compile(p)
    for p in (
        r"\n(?=#{1,6} |第[0-9０-９一二三四五六七八九十百]+[章节] |Chapter \d)",
        r"\n[ \t\r]*\n+",
        r"\n",
        r"[。！？!?…]+[”’」』）)\"']*|\.[\"')]*(?=\s)",
        r"[；;：，、]|[,:](?=\s)",
        r"[ \t\u3000]+",
    )
)


def _cut(text: str, start: int, end: int, room: int, level: int, out: list[int]) -> None:
    """Append the ends of the atoms of text[start:end], each of at most room characters."""
    stack = [(start, end, level)]
    while stack:
        start, end, level = stack.pop()
        if end - start <= room:
            if end > start:
                out.append(end)
            continue
        if level == len(SEPARATORS):
            at = start
            while end - at > room:
                to = at + room
                while to > at + 1 and (unicodedata.combining(text[to]) or text[to] in "\u200d\ufe0e\ufe0f" or text[to - 1] == "\u200d" or text[to - 1 : to + 1] == "\r\n"):
                    to -= 1
                if to == at + 1:
                    to = at + room
                out.append(to)
                at = to
            out.append(end)
            continue
        ends = [m.end() for m in SEPARATORS[level].finditer(text, start, end) if start < m.end() < end]
        parts = list(zip([start, *ends], [*ends, end]))
        stack.extend((a, b, level + 1) for a, b in reversed(parts))


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The [start, end) of each piece. A null text has none, a text within the limit has one (an empty one, too)."""
    if text is None:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    atoms: list[int] = []
    _cut(text, 0, len(text), limit - overlap, 0, atoms)
    pieces, start, end = [], 0, 0
    for at in atoms:
        if at - start > limit:
            pieces.append((start, end))
            start = end - overlap
        end = at
    pieces.append((start, end))
    return pieces


def split_oversized(df: DataFrame, key: str = "row_id", text: str = "content", carry: tuple[str, ...] = ("level",), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece: key, the carried columns, piece_no (from 0), pieces, content, char_count, overlap_chars.

    Null texts give no row; empty and short ones give one piece equal to the text. Repeated rows are cut each on their
    own. char_count is counted here, in code points; whatever the input says isn't read. An empty table gives none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    kept = [key, *carry]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    fields = dict(df.select(packed.alias("k")).dtypes)["k"]

    def make():
        def run(cols):
            keys, texts = cols
            out = [[] for _ in range(6)]
            for k, t in zip(keys, texts):
                pieces = split_text(t, limit, overlap)
                for no, (a, b) in enumerate(pieces):
                    for o, v in zip(out, (k, no, len(pieces), t[a:b], b - a, overlap if no else 0)):
                        o.append(v)
            return out

        return run

    flat = map_rows(df.select(packed.alias("k"), F.col(f"`{text}`").alias("t")), ["k", "t"], make, schema(f"k {fields}, piece_no INT, pieces INT, content STRING, char_count INT, overlap_chars INT"))
    return flat.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(kept)], "piece_no", "pieces", "content", "char_count", "overlap_chars")
