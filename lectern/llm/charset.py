"""Character classes that several text operators share."""

from __future__ import annotations

import functools
import re
import unicodedata

# Invisible code points that carry no text.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"


@functools.cache
def gb_han(level: int) -> frozenset[str]:
    """The Han characters of a level of the GB 2312 code table: lead bytes B0 to D7 (common), D8 to F7 (less common)."""
    leads = range(0xB0, 0xD8) if level == 1 else range(0xD8, 0xF8)
    out = set()
    for lead in leads:
        for trail in range(0xA1, 0xFF):
            try:
                out.add(bytes((lead, trail)).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return frozenset(out)


@functools.cache
def char_class(chars: str) -> str:
    """A regex class body of the characters, as ranges."""
    points, out = sorted(set(map(ord, chars))), []
    start = prev = None
    for p in [*points, None]:
        if prev is not None and p == prev + 1:
            prev = p
            continue
        if start is not None:
            out.append(re.escape(chr(start)) if start == prev else f"{re.escape(chr(start))}-{re.escape(chr(prev))}")
        start = prev = p
    return "".join(out)


@functools.cache
def clean_class() -> str:
    """Class body of the characters that occur in text decoded rightly, look-alike forms among them."""
    han = char_class("".join(sorted(gb_han(1) | gb_han(2))))
    accents = char_class("".join(c for c in map(chr, range(0xDF, 0x250)) if unicodedata.category(c) == "Ll" and len(unicodedata.normalize("NFD", c)) > 1) + "çøæœßı")
    # signs that wrong decodings produce as well, such as \u00ac or \u2122, are left out
    plain = char_class("“”‘’—–―…·•、。〈〉《》「」『』【】〔〕～°±½×÷²→≤≥")
    return (
        r"\t\n\r\x20-\x7e" + han + accents + plain + char_class(INVISIBLE)
        + r"\u00a0\u2000-\u200a\u202f\u205f\u2010-\u2012\u3000\uff01-\uff5e\u0300-\u036f\u0391-\u03c9\u0410-\u044f\u0451\u0455\u0456\u0458\u04bb"
        + r"\u2e80-\u2fd5\uf900-\ufaff\ufb00-\ufb06\u2600-\u27bf\ufe0e\ufe0f\U0001f300-\U0001faff"
    )
