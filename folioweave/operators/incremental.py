"""Doing only what isn't done, and counting what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skip_existing(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``done`` doesn't have."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def already_done(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``done`` has."""
    return docs.join(done.select(key).distinct(), key, "left_semi")


def outcome(done: Column, text: Column) -> Column:
    """skipped, failed (no text) or processed."""
    return F.when(done, "skipped").when(F.coalesce(F.length(text), F.lit(0)) == 0, "failed").otherwise("processed")


def run_statistics(rows: DataFrame, outcome: str, chunks: Column | None = None, output: Column | None = None) -> DataFrame:
    """One row: total_files, processed, skipped, failed, total_chunks, avg_chunks and, if ``output`` is given, output_files."""
    one = lambda kind: F.count_if(F.col(outcome) == kind)
    made = F.sum(F.when(F.col(outcome) == "processed", chunks if chunks is not None else F.lit(None))).cast("long")
    numbers = [F.count(F.lit(1)).alias("total_files"), *(one(k).alias(k) for k in ("processed", "skipped", "failed")), made.alias("total_chunks"), F.try_divide(made, one("processed")).alias("avg_chunks")]
    files = [F.sort_array(F.collect_list(F.when(F.col(outcome) == "processed", output))).alias("output_files")] if output is not None else []
    return rows.agg(*numbers, *files)


def chunk_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Number of chunks and their mean, least and greatest length."""
    n = F.length(text)
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))
