"""Cleaning of Markdown that a PDF parser wrote: column to column, one projection, in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matches, replace_all, rx

# Garbled strings that the parser leaves behind, in the order of their removal.
GARBAGE = ("订ካ఻୲ͻጇፒ", "啖ᚂ䄫❵啗", "订ካ఻୲ͻ紊ፒ", "ኄ", "୲ͻጇፒ", "ᝠካ఻")
# Running titles that are removed where they stand as paragraphs.
RUNNING_TITLES = ("存储器管理", "存储器管", "操作系统", "计算机系统", "计算机操作系统", "慕课版", "上册", "下册")
# Circled digits and what they become.
CIRCLED = (("①", "(1)"), ("②", "(2)"), ("③", "(3)"), ("④", "(4)"), ("⑤", "(5)"), ("⑥", "(6)"), ("⑦", "(7)"), ("⑧", "(8)"), ("⑨", "(9)"), ("⑩", "(10)"))
# Entities in the order of their decoding.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
# Words before which a short paragraph counts as a fragment.
OPENERS = "计算机操作系统|操作系统|上述|下面|因此|所以|但是|然而|同时|此外"
# Beginnings that a title can't have, and the level that a title's numbering gives, first match wins.
NO_TITLE = (
    r"(int|void|char|float|double|boolean|typedef|struct|enum|class|const|static)",
    r"[a-zA-Z_]\w*\s*[\[\(=;]",
    r"[\d\s]+[）\)]$",
    r"[}{\[\];,\(\)]+$",
    r"\d+\s*(退出区|剩余区|临界区)",
    r"(while|for|if|return)",
)
LEVELS = ((r"第\s*[0-9０-９]+\s*章", 1), (r"\d+\.\d+\.\d+\.\d+", 4), (r"\d+\.\d+\.\d+", 3), (r"\d+\.\d+", 2), (r"\d+[．\.][一-龥]", 4), (r"\d+[．\.\s]", 2))
IMAGE = "\n\n> 📷 **[图片]**\n\n"

AFTER_IMAGE = rx(r"(> 📷 \*\*\[图片\]\*\*.*?\n\n)([^\n#]{1,15}\n\n)")
ISOLATED_HAN = rx(r"\n\n([一-龥]{1,10})\n\n")
ISOLATED_NUMBER = rx(r"\n\n(\d{1,4})\n\n")
ISOLATED_CHAPTER = rx(r"\n\n(第\s*\d+\s*章)\n\n")
AFTER_HEADING = rx(r"(#{1,6}\s+.+?\n\n)([^\n#]{1,15}\n\n)(?=[^\n])")
FRAGMENT = rx(rf"\n\n([^\n#]{{1,10}})\n\n({OPENERS})")


def remove_garbage(c: Column) -> Column:
    return replace_all(c, [(g, "") for g in GARBAGE])


def join_chapter_heading(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"## (第\d+章)\s*\n+## ([^\n]+)"), "## $1 $2")


def image_placeholder(c: Column) -> Column:
    return F.replace(c, F.lit("<!-- image -->"), F.lit(IMAGE))


def drop_after_image(c: Column) -> Column:
    return F.regexp_replace(c, AFTER_IMAGE, "$1")


def drop_isolated_han(c: Column) -> Column:
    """Of two short paragraphs side by side the second stays: a match takes the break after it."""
    return F.regexp_replace(c, ISOLATED_HAN, "\n\n")


def drop_running_titles(c: Column) -> Column:
    return replace_all(c, [(f"\n\n{t}\n\n", "\n\n") for t in RUNNING_TITLES])


def drop_isolated_number(c: Column) -> Column:
    return F.regexp_replace(c, ISOLATED_NUMBER, "\n\n")


def drop_isolated_chapter(c: Column) -> Column:
    return F.regexp_replace(c, ISOLATED_CHAPTER, "\n\n")


def drop_after_heading(c: Column) -> Column:
    return F.regexp_replace(c, AFTER_HEADING, "$1")


def drop_fragments(c: Column) -> Column:
    return F.regexp_replace(c, FRAGMENT, "\n\n$2")


def title_valid(c: Column) -> Column:
    """Whether a text can be a title. Keywords reject as prefixes, so 'Internet' falls with 'int'."""
    bad = reduce(lambda a, b: a | b, [c.rlike(rx("^" + p, "i")) for p in NO_TITLE])
    return ~bad & (F.length(c) >= 2) & ~c.rlike(rx(r"^[^\w]+$")) & ~c.rlike(rx(r"^[\d\s\W]+$"))


def title_level(c: Column) -> Column:
    level = F.lit(3)
    for pattern, n in reversed(LEVELS):
        level = F.when(c.rlike(rx("^" + pattern)), n).otherwise(level)
    return F.when(title_valid(c), level).otherwise(0)


def normalize_headings(c: Column, fences: bool = False) -> Column:
    """Give each line that begins with # the level of its numbering, or none.

    fences=False also rewrites such lines inside code, as the pipeline always did; True leaves code alone.
    """

    def line(x: Column) -> Column:
        bare = F.regexp_replace(x, rx(r"^\s+|\s+$"), "")
        title = F.regexp_replace(bare, rx(r"^#+\s*"), "")
        level = title_level(title)
        marked = F.when(level == 0, title).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title))
        return F.when(bare.startswith("#"), marked).otherwise(x)

    whole = lambda t: F.array_join(F.transform(F.split(t, "\n", -1), line), "\n")
    if not fences:
        return whole(c)
    return F.array_join(F.transform(F.split(c, "```", -1), lambda s, i: F.when(i % 2 == 1, s).otherwise(whole(s))), "```")


def circled_digits(c: Column) -> Column:
    return replace_all(c, CIRCLED)


def full_width_dot(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"(\d+)．"), "$1.")


def decode_entities(c: Column) -> Column:
    return replace_all(c, ENTITIES)


def unescape_underscore(c: Column) -> Column:
    return F.replace(c, F.lit(r"\_"), F.lit("_"))


def code_punctuation(c: Column) -> Column:
    """Half-width punctuation inside closed fences; what follows a fence that is never closed stays."""
    parts = F.split(c, "```", -1)
    return F.array_join(F.transform(parts, lambda s, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), F.translate(s, "；，（）", ";,()")).otherwise(s)), "```")


def collapse_blank(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rx(r"\n{3,}"), "\n\n"), rx(r"[ \t]+$", "m"), "")


def space_blocks(c: Column) -> Column:
    for pattern in (r"([^\n])\n(#{1,4} )", r"(#{1,4} [^\n]+)\n([^\n#])", r"([^\n])\n(```)", r"(```)\n([^\n`])"):
        c = F.regexp_replace(c, rx(pattern), "$1\n\n$2")
    return F.regexp_replace(c, rx(r"\n{3,}"), "\n\n")


def final_trim(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, r"^\n+|\n+$", ""), F.lit("\n"))


#: The cleaning steps in their order.
STEPS = (
    ("garbage", remove_garbage), ("join_chapter", join_chapter_heading), ("image", image_placeholder),
    ("after_image", drop_after_image), ("isolated_han", drop_isolated_han), ("running_titles", drop_running_titles),
    ("isolated_number", drop_isolated_number), ("isolated_chapter", drop_isolated_chapter), ("after_heading", drop_after_heading),
    ("fragments", drop_fragments), ("headings", normalize_headings), ("circled", circled_digits), ("dot", full_width_dot),
    ("entities", decode_entities), ("underscore", unescape_underscore), ("code", code_punctuation), ("blank", collapse_blank),
    ("spacing", space_blocks), ("trim", final_trim),
)


def clean(c: Column) -> Column:
    return reduce(lambda x, step: step[1](x), STEPS, c)


def cleaning_counts(c: Column) -> Column:
    """What the counted steps find, each in the text that reaches it: a struct of counts and the change in length."""
    counted = {"images": ("image", None), "after_image": ("after_image", AFTER_IMAGE), "isolated_han": ("isolated_han", ISOLATED_HAN), "isolated_number": ("isolated_number", ISOLATED_NUMBER), "isolated_chapter": ("isolated_chapter", ISOLATED_CHAPTER), "after_heading": ("after_heading", AFTER_HEADING), "fragments": ("fragments", FRAGMENT)}
    by_step = {step: (name, pattern) for name, (step, pattern) in counted.items()}
    out, now = {}, c
    for step, apply in STEPS:
        if step in by_step:
            name, pattern = by_step[step]
            out[name] = ((F.length(now) - F.length(F.replace(now, F.lit("<!-- image -->"), F.lit("")))) / 14).cast("int") if pattern is None else matches(now, pattern)
        now = apply(now)
    return F.struct(*[v.alias(k) for k, v in out.items()], (F.length(now) - F.length(c)).alias("length_change"))
