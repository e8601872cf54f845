"""Sections to chunks: packing of sentences and merging of small chunks, as folds inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions.text import rx, strip
from ..schema import CHUNK
from . import sections as S


def pack_sentences(c: Column, limit: int = config.MAX_CHUNK, separators: str = "。！？\n") -> Column:
    """An array of pieces: sentences with their separators, as many as fit. A sentence longer than limit stays whole."""
    units = F.split(c, f"(?<=[{separators}])", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, unit: Column) -> Column:
        full = F.length(acc["cur"]) + F.length(unit) > limit
        flushed = F.when(full & (acc["cur"] != ""), F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])
        return F.struct(flushed.alias("out"), F.when(full, unit).otherwise(F.concat(acc["cur"], unit)).alias("cur"))

    return F.aggregate(units, start, step, lambda acc: F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]))


def flags(content: Column) -> tuple[Column, Column]:
    """Whether there is code and whether there is an image."""
    return content.contains("```"), content.contains("📷") | content.contains("[图片]")


def merge_small(chunks: DataFrame, limit: int = config.MAX_CHUNK, least: int = config.MIN_CHUNK) -> DataFrame:
    """doc_id, ordinal and the chunk columns: chunks below the least size join the one before, or fall away.

    chunks: doc_id, ordinal and the chunk columns. Each big chunk begins anew, so a document falls into runs of a big
    chunk and the small ones after it; runs are folded each on their own, and no task ever holds a whole document. Of
    the small ones of a run only those are gathered that can still join: none before the first that fits; after it a
    chunk only grows, by at least two characters a time, so of each size only the first limit / 2 can.
    Merging crosses sections and chapters, and the headings of the earlier chunk stay.
    """
    names = ["ordinal", *CHUNK.names]
    so_far = W.partitionBy("doc_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    runs = chunks.withColumn("run", F.sum((F.col("char_count") >= least).cast("int")).over(so_far)).filter("run > 0")
    run, count, small = W.partitionBy("doc_id", "run"), F.col("char_count"), F.col("char_count") < least
    fits = runs.withColumn("_first", F.first("char_count").over(run.orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    fits = fits.withColumn("_begun", F.min(F.when(small & (count + F.col("_first") + config.JOIN_CHARS <= limit), F.col("ordinal"))).over(run))
    fits = fits.filter(~small | (F.col("ordinal") >= F.col("_begun")))
    same = W.partitionBy("doc_id", "run", "char_count").orderBy("ordinal")
    runs = fits.withColumn("_place", F.row_number().over(same)).filter(~small | (F.col("_place") <= limit // config.JOIN_CHARS))
    item = F.struct(*names)
    packed = runs.groupBy("doc_id", "run").agg(F.min_by(item, "ordinal").alias("first"), F.array_sort(F.collect_list(F.when(F.col("char_count") < least, item))).alias("rest"))
    kind = dict(packed.dtypes)["first"]

    def step(cur: Column, x: Column) -> Column:
        content = F.concat(cur["content"], F.lit("\n\n"), x["content"])
        new = {"content": content, "char_count": F.length(content), "has_code": cur["has_code"] | x["has_code"], "has_image": cur["has_image"] | x["has_image"]}
        joined = F.struct(*[new.get(n, cur[n]).alias(n) for n in names]).cast(kind)
        return F.when(cur["char_count"] + x["char_count"] + config.JOIN_CHARS <= limit, joined).otherwise(cur)

    return packed.select("doc_id", F.aggregate("rest", F.col("first").cast(kind), step).alias("chunk")).select("doc_id", "chunk.*")


def section_chunks(sections: DataFrame, limit: int = config.MAX_CHUNK) -> DataFrame:
    """Chunks before merging: doc_id, ordinal and the chunk columns, numbered in the order of the document."""
    placed = S.heading_context(sections).filter(F.length(strip(F.col("content"))) >= config.MIN_BODY)
    table = F.col("content").rlike(rx(r"^\s*<table"))
    pieces = F.when((F.length("content") > limit) & ~table, pack_sentences(F.col("content"), limit)).otherwise(F.array("content"))
    spread = placed.withColumn("piece", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size(pieces) - 1).alias("no"), pieces.alias("text"))))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("pos", F.col("piece.no")))
    code, image = flags(F.col("piece.text"))
    numbered = spread.withColumn("ordinal", number)
    return numbered.select(
        "doc_id", "ordinal", S.chunk_id(F.col("chapter"), F.col("chapter_num"), F.col("section_h2"), F.col("ordinal")).alias("chunk_id"),
        "chapter", "section_h2", "section_h3", "section_h4", strip(F.col("piece.text")).alias("content"), "level",
        F.length("piece.text").alias("char_count"), code.alias("has_code"), image.alias("has_image"),
    )


def chunk_documents(df: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = config.MAX_CHUNK, least: int = config.MIN_CHUNK) -> DataFrame:
    """Documents to chunks: sections, heading context, packing, merging. One exchange, by document."""
    return merge_small(section_chunks(S.parse_sections(df, doc, text), limit), limit, least)
