"""Text, chunk, table and binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.text import stem
from ..schema import CHUNK, QA, fields


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """doc_id, text: one row a file; doc_id is the file's name without its ending."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("doc_id"), F.col("value").alias("text"))


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(text).write.mode("overwrite").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files as JSON arrays or lines, with book_name from the file's name."""
    rows = spark.read.schema(CHUNK).option("multiLine", True).json(path)
    return rows.withColumn("book_name", stem(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))


def write_chunks(df: DataFrame, path: str, book: str | None = None) -> None:
    """JSON lines, by book where a column is named; characters outside ASCII stay as they are."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(book) if book else writer).json(path)


def chunk_preview(chunks: DataFrame, chars: int = 500) -> DataFrame:
    """One text a chunk: a banner, its place, the beginning of its content."""
    more = F.when(F.length("content") > chars, F.lit("\n... (内容已截断)")).otherwise(F.lit(""))
    head = F.concat(F.lit("=" * 80), F.lit("\nChunk: "), F.col("chunk_id"), F.lit("\n"), F.concat_ws(" > ", *[F.nullif(F.col(c), F.lit("")) for c in ("chapter", "section_h2", "section_h3", "section_h4")]), F.lit("\n"), F.lit("-" * 80), F.lit("\n"))
    return chunks.select(F.concat(head, F.substring("content", 1, chars), more).alias("text"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with a header; a byte order mark before the first name doesn't matter, the schema names the columns."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """A table with a header, with a byte order mark in front of the first name, as spreadsheets want it."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True)


def write_qa(df: DataFrame, path: str) -> None:
    df.select(*QA.names).write.mode("overwrite").json(path)


def from_columns(spark: SparkSession, columns: dict[str, list], schema: T.StructType) -> DataFrame:
    """A table from lists, one a column."""
    return spark.createDataFrame(list(zip(*[columns[f.name] for f in schema.fields])), schema)


def segments(pages: Column, size: int = config.PAGES_PER_SEGMENT) -> Column:
    """Page ranges [first, last] of a document, counted from 1; a document of at most `size` pages is one range."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(pages / size).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(i.alias("segment"), (i * size + 1).alias("first"), F.least((i + 1) * size, pages).alias("last")))


def discover(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, name of the files of a folder whose names match, in order of their names; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return found.withColumn("name", F.substring_index("path", "/", -1)).orderBy("name", "path")


Parser = Callable[[bytes, int, int], str]


def parse_pdfs(files: DataFrame, pages: Callable[[bytes], int], parser: Callable[[], Parser], size: int = config.PAGES_PER_SEGMENT) -> DataFrame:
    """path, text: PDFs through a parser made once in each task, in segments, joined by blank lines in their order.

    files: path, content, as binaryFile reads them. A segment whose parser fails is an empty text; its document stays.
    """
    counted = files.withColumn("pages", F.udf(pages, T.IntegerType())("content"))
    parts = counted.select("path", "content", F.inline(segments(F.col("pages"), size)))

    def run(batches: Iterator) -> Iterator:
        parse = parser()
        for pdf in batches:
            texts = []
            for content, first, last in zip(pdf["content"], pdf["first"], pdf["last"]):
                try:
                    texts.append(parse(content, first, last))
                except Exception:  # noqa: BLE001
                    texts.append("")
            yield pdf[["path", "segment"]].assign(text=texts)

    done = parts.mapInPandas(run, T.StructType([*fields("si", "path", "segment").fields, T.StructField("text", T.StringType())]))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "text")))
    return done.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def extract_images(files: DataFrame, extractor: Callable[[], Callable[[bytes], list[bytes]]]) -> DataFrame:
    """path, name, image: the images of each file, named image_001.png and so on."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        find = extractor()
        for pdf in batches:
            rows = [(p, f"image_{i:03d}.png", b) for p, c in zip(pdf["path"], pdf["content"]) for i, b in enumerate(find(c), 1)]
            yield pd.DataFrame(rows, columns=["path", "name", "image"])

    return files.select("path", "content").mapInPandas(run, T.StructType([*fields("ss", "path", "name").fields, T.StructField("image", T.BinaryType())]))
