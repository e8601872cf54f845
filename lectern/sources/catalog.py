"""Collections of embedded chunks: one table partitioned by book in place of a collection each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..session import small

PREFIX = "textbook_"


def upsert(df: DataFrame, path: str, clear: bool = True) -> None:
    """Write the books of df, each replacing what was stored of it; without clear their rows are added."""
    writer = df.write.partitionBy("book_name").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if clear else "append").parquet(path)


def scan(spark: SparkSession, path: str, book: str | None = None) -> DataFrame:
    """All rows, or those of one book, of which only its partition is read."""
    stored = spark.read.parquet(path)
    return stored if book is None else stored.filter(F.col("book_name") == book)


def lookup(chunks: DataFrame, wanted: DataFrame, key: str = "chunk_id", rows: int = config.BROADCAST_ROWS) -> DataFrame:
    """The chunks with the wanted ids. Few ids go to all tasks, and the chunks stay where they are; more are joined."""
    ids = wanted.select(key).distinct()
    return chunks.join(F.broadcast(ids) if small(ids, rows) else ids, key, "left_semi")


def names(collections: DataFrame) -> DataFrame:
    """The collections of books in order of their names, by the same pattern that a catalog query uses."""
    return collections.filter(F.col("name").like("textbook_%")).select("name").orderBy("name")


def book_of(name):
    """The book of a collection's name: every occurrence of the prefix goes."""
    return F.replace(name, F.lit(PREFIX), F.lit(""))


def counts(chunks: DataFrame, book: str = "book_name") -> DataFrame:
    return chunks.groupBy(book).agg(F.count("*").alias("chunks"))


def samples(chunks: DataFrame, book: str = "book_name", ordinal: str = "row_id") -> DataFrame:
    """The first chunk of each book. A minimum is found before anything is exchanged, so a big book costs one row a task."""
    first = F.min_by(F.struct(*chunks.columns), F.col(ordinal))
    return chunks.groupBy(book).agg(first.alias("row")).select("row.*")


def existing(questions: DataFrame, collections: DataFrame, book: str = "book_name") -> DataFrame:
    return questions.join(collections.select(book), book, "left_semi")


def missing(questions: DataFrame, collections: DataFrame, book: str = "book_name") -> DataFrame:
    return questions.join(collections.select(book), book, "left_anti")


def with_all(collections: DataFrame, name: str = "all") -> DataFrame:
    """The books and one more row that stands for all of them."""
    extra = collections.sparkSession.createDataFrame([(name,)], "book_name STRING")
    return collections.select("book_name").unionByName(extra)


def drop(spark: SparkSession, path: str, book: str) -> None:
    """Remove the rows of a book: its partition is written empty. Never asks."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/book_name={book}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def latest(df: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The last loaded of the rows that share a key."""
    place = W.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")
