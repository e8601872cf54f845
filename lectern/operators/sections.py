"""Markdown documents to sections with their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rx, strip

#: Up to four signs and something after them; five or more are body text.
HEADING = r"#{1,4}[^\S\n]+[^\n]+"


def parse_sections(df: DataFrame, doc: str = "doc_id", text: str = "text", keep_empty: bool = False) -> DataFrame:
    """doc_id, pos, level, title, content: one row a section with a body, in the order of the document.

    Text is cut before each heading line inside its own row, so nothing is shuffled. Blank lines vanish. A heading
    without a body is dropped before it can set a context, unless keep_empty.
    """
    cut = F.split(F.col(text), rx(rf"(?=^{HEADING}$)", "m"), -1)
    one = df.select(F.col(doc).alias("doc_id"), F.posexplode(cut).alias("pos", "part")).filter(F.col("part") != "")
    first = F.substring_index("part", "\n", 1)
    headed = first.rlike(rx(rf"^{HEADING}$"))
    level = F.when(headed, F.length(F.regexp_extract(first, r"^(#{1,4})", 1))).otherwise(0)
    title = F.when(headed, strip(F.regexp_extract(first, rx(r"^#{1,4}\s+(.+)$"), 1))).otherwise(F.lit(""))
    body = F.when(headed, F.substring(F.col("part"), F.length(first) + 2, F.length("part"))).otherwise(F.col("part"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(rx(r"\S")))
    out = one.select("doc_id", "pos", level.cast("int").alias("level"), title.alias("title"), F.array_join(lines, "\n").alias("content"), (F.size(lines) > 0).alias("has_body"))
    return (out if keep_empty else out.filter("has_body")).drop("has_body")


def heading_context(sections: DataFrame) -> DataFrame:
    """Adds chapter, section_h2 to section_h4 and chapter_num as they stand at each section.

    A heading of a level holds until one of a higher level comes; windows over each document carry it.
    """
    run = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)

    def at(k: int) -> Column:
        return F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(run)

    def reset(k: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("level").between(1, k - 1), F.col("pos"))).over(run), F.lit(-1))

    out = sections
    for k, name in ((1, "chapter"), (2, "section_h2"), (3, "section_h3"), (4, "section_h4")):
        value = at(k)
        held = value["title"] if k == 1 else F.when(value["pos"] > reset(k), value["title"])
        out = out.withColumn(name, F.coalesce(held, F.lit("")))
    return out.withColumn("chapter_num", F.sum((F.col("level") == 1).cast("int")).over(run).cast("int"))


def chunk_id(chapter: Column, chapter_num: Column, h2: Column, counter: Column) -> Column:
    """ch<n>_s<a_b>_p<ccc>, or ch<n>_p<ccc> where the second heading has no number."""
    found = F.regexp_extract(chapter, rx(r"第\s*(\d+)\s*章"), 1)
    number = F.when(found != "", found).otherwise(chapter_num.cast("string"))
    section = F.replace(F.regexp_extract(h2, rx(r"^(\d+\.\d+)"), 1), F.lit("."), F.lit("_"))
    head = F.concat(F.lit("ch"), number, F.when(section != "", F.concat(F.lit("_s"), section)).otherwise(F.lit("")))
    return F.concat(head, F.lit("_p"), F.format_string("%03d", counter))
