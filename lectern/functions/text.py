"""String functions with the semantics of Unicode-aware text processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML escapes in the order they are applied.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern with Unicode classes and newline as the only line end."""
    return f"(?Ud{flags}){pattern}"


def strip(c: Column) -> Column:
    """Trim any Unicode white space from both ends."""
    return F.regexp_replace(c, rx(r"^\s+|\s+$"), "")


def replace_all(c: Column, pairs) -> Column:
    """Literal replacements one after another; the order matters where one makes a match for another."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def occurrences(c: Column, text: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def html_escape(c: Column) -> Column:
    return replace_all(c, HTML_ESCAPES)


def snippet(c: Column, chars: int = 220) -> Column:
    """The beginning of a text with an ellipsis if more follows, safe for HTML."""
    return html_escape(F.concat(F.substring(c, 1, chars), F.when(F.length(c) > chars, F.lit("...")).otherwise(F.lit(""))))


def preview(c: Column, chars: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit(mark))).otherwise(c)


def section_path(*parts: Column, default: str = "未标注章节") -> Column:
    """Non-empty headings joined by ' > '."""
    joined = F.concat_ws(" > ", *[F.nullif(strip(p), F.lit("")) for p in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def title_case(c: Column) -> Column:
    """Capital letters after anything that is no letter, small ones elsewhere."""
    words = F.split(F.lower(c), rx(r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"), -1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def stem(c: Column) -> Column:
    """The name of a chunk file without its suffix."""
    return F.regexp_replace(c, "_chunks$", "")


def chunks_name(c: Column) -> Column:
    return F.replace(c, F.lit("_cleaned"), F.lit("_chunks"))


def collection_name(c: Column, known: dict[str, str] | None = None) -> Column:
    """A safe collection name: a known one, else the allowed characters, else a hash that is the same everywhere."""
    safe = F.nullif(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_"), "^_+|_+$", ""), F.lit(""))
    hashed = F.concat(F.lit("book_"), F.pmod(F.xxhash64(c), F.lit(1_000_000)).cast("string"))
    if not known:
        return F.coalesce(safe, hashed)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(table[c], safe, hashed)


def book_label(c: Column, label: Column | None = None) -> Column:
    """The printed label where there is one, else the key made readable."""
    readable = title_case(F.replace(c, F.lit("_"), F.lit(" ")))
    return readable if label is None else F.coalesce(label, readable)


def selection(c: Column, total: Column | int) -> Column:
    """Zero-based positions chosen by 'all', '1', '1,3-5'; out of range ones dropped, sorted, each once.

    A range that runs backwards chooses nothing. Parts that are no numbers raise under ANSI mode.
    """
    total = F.lit(total) if isinstance(total, int) else total
    everything = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))

    def part(p: Column) -> Column:
        ends = F.split(p, "-", 2)
        low, high = F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when(low <= high, F.sequence(low - 1, high - 1)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, part))))
    inside = F.filter(chosen, lambda i: (i >= 0) & (i < total))
    return F.when(F.lower(F.trim(c)) == "all", everything).otherwise(inside)
