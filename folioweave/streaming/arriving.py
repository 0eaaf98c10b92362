"""Cleaning and chunking of texts as their files arrive: each file once, however often the query is restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioweave.functions.cleaning import clean_text
from folioweave.operators import recursive


def arriving_texts(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """A stream of ``source_file``, ``text`` and ``arrived`` for the text files that come into a directory."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("source_file"), text.alias("text"), F.col("modificationTime").alias("arrived"))


def clean_and_chunk(texts: DataFrame, *, chunk_size: int = 1000, chunk_overlap: int = 200) -> DataFrame:
    """The same plan for a stream as for a table."""
    cleaned = texts.withColumn("text", clean_text(F.col("text"))).where(F.length("text") > 0)
    return recursive.to_chunks(cleaned.withColumn("chunks", recursive.split(F.col("text"), chunk_size=chunk_size, chunk_overlap=chunk_overlap)), "chunks", "source_file")


def write(chunks: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks to a Parquet table, exactly once, and ends when all files that are there have been read."""
    return chunks.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(chunks: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each batch and its number to ``put``, which can make repeated batches one by the number."""
    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_interval(chunks: DataFrame, *, interval: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Numbers of arriving documents by interval of ``arrived``; those later than ``late`` are left out."""
    return chunks.withWatermark("arrived", late).groupBy(F.window("arrived", interval)).agg(F.count(F.lit(1)).alias("documents"))
