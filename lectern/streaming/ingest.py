"""A landing folder of Markdown files to chunks, as a stream.

Cleaning and chunking are per document, so no state and no watermark is needed; each micro-batch replaces the books it
brings. The reference has no streams: this is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.markdown import clean
from ..operators.packing import chunk_documents
from ..sources import catalog


def documents(spark: SparkSession, landing: str) -> DataFrame:
    """doc_id, text of the files that arrive."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(landing)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("doc_id"), F.col("value").alias("text"))


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the stream. A batch that runs again writes the same partitions again, so each file counts once."""

    def write(batch: DataFrame, _: int) -> None:
        cleaned = batch.select("doc_id", clean(F.col("text")).alias("text"))
        chunks = chunk_documents(cleaned).withColumnRenamed("doc_id", "book_name")
        catalog.upsert(chunks, store)

    writer = documents(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
