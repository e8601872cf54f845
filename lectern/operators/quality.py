"""Reports on the quality of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import matches, occurrences, rx, strip

ISSUES = ("code_truncated", "has_line_numbers", "too_small", "too_large", "empty_code")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, chars, mean_chars (0 without chunks), with_code, with_image."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"), F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("mean_chars"),
        F.count_if("has_code").alias("with_code"), F.count_if("has_image").alias("with_image"),
    )


def level_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("level").agg(F.count("*").alias("chunks"))


def markdown_stats(c: Column) -> Column:
    """Counts of headings, paragraphs, short isolated paragraphs, code blocks and characters, as a struct."""
    heads = [matches(c, rf"(?m)^#{{{n}}} ").alias(f"h{n}") for n in (1, 2, 3, 4)]
    return F.struct(
        *heads, matches(c, rx(r"\n\n[^\n#].{20,}")).alias("paragraphs"), matches(c, rx(r"\n\n([^\n#]{1,15})\n\n")).alias("isolated"),
        F.floor(matches(c, "(?m)^```") / 2).cast("int").alias("code_blocks"), F.length(c).alias("chars"),
    )


def parse_report(c: Column) -> Column:
    """What the parser left: plain counts of literals. A heading in the first line isn't counted."""
    counted = {"h2": "\n## ", "h3": "\n### ", "placeholders": "<!-- image -->", "fences": "```", "blank_lines": "\n\n"}
    return F.struct(F.length(c).alias("chars"), F.size(F.split(c, "\n", -1)).alias("lines"), *[occurrences(c, s).alias(k) for k, s in counted.items()])


def parse_issues(report: Column) -> Column:
    found = F.array(F.when(report["placeholders"] > 0, F.lit("placeholders")), F.when(report["chars"] < config.SHORT_DOCUMENT, F.lit("short")))
    return F.filter(found, lambda x: x.isNotNull())


def chunk_issues(content: Column, char_count: Column, has_code: Column) -> Column:
    """The issues of a chunk, an array; only the two of its size exclude each other."""
    body = strip(content)
    fence = F.regexp_extract(content, r"(?s)```.*?```", 0)
    found = F.array(
        F.when(has_code & (body.startswith("```\n\n}") | body.startswith("```\n\n)")), F.lit("code_truncated")),
        F.when(content.rlike(rx(r"^\s*\d+\s+[a-zA-Z_]\w*\s*\(", "m")), F.lit("has_line_numbers")),
        F.when(char_count < config.ISSUE_SMALL, F.lit("too_small")).when(char_count > config.ISSUE_LARGE, F.lit("too_large")),
        F.when(has_code & (fence != "") & (F.length(fence) < config.EMPTY_CODE), F.lit("empty_code")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def rate_status(rate: Column) -> Column:
    return F.when(rate < config.RATE_GOOD, "excellent").when(rate < config.RATE_POOR, "good").otherwise("poor")


def issue_report(chunks: DataFrame, issues: str = "issues") -> DataFrame:
    """issue, chunks, percent, status; every issue has a row. The total comes from the same pass over the chunks."""
    spread = chunks.select(F.explode(F.concat(F.array(F.lit("")), F.col(issues))).alias("issue")).groupBy("issue").agg(F.count("*").alias("chunks"))
    names = chunks.sparkSession.createDataFrame([(i,) for i in ISSUES], "issue STRING")
    total = spread.filter("issue = ''").select(F.col("chunks").alias("total"))
    counted = names.join(spread, "issue", "left").select("issue", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))
    # one row beside five
    rate = counted.join(F.broadcast(total), F.lit(True), "left").withColumn("percent", F.coalesce(F.col("chunks") * 100.0 / F.col("total"), F.lit(0.0)))
    return rate.select("issue", "chunks", F.round("percent", 6).alias("percent"), rate_status(F.col("percent")).alias("status"))


def overall_grade(chunks: DataFrame, issues: str = "issues") -> DataFrame:
    """One row: total, issues (each counted), rate, grade."""
    summed = chunks.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.size(issues)), F.lit(0)).alias("issues"))
    rate = F.when(F.col("total") > 0, F.col("issues") * 100.0 / F.col("total")).otherwise(0.0)
    return summed.select("total", "issues", F.round(rate, 6).alias("rate"), rate_status(rate).alias("grade"))


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """Labels by how often they occur, most first."""
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label)


def throughput(rows: Column, seconds: Column) -> Column:
    """A struct of seconds, seconds a row and rows a second; null rates without rows or time."""
    per_row = seconds / F.nullif(rows, F.lit(0))
    return F.struct(seconds.alias("seconds"), per_row.alias("seconds_per_row"), (rows / F.nullif(seconds, F.lit(0.0))).alias("rows_per_second"))
