"""Directories of documents as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.functions.cleaning import join_pages, stem

PROPERTIES = ("title", "author", "subject", "creator", "producer", "creation_date", "modification_date")
#: Pages of a document and its properties; ``extractor`` of ``extract_pages`` makes them from a file's bytes.
Extractor = Callable[[bytes], tuple[list[str], dict[str, object]]]

_FILE = "path string, modificationTime timestamp, length long, content binary"


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("source_file", F.regexp_extract("path", "[^/]*$", 0))


def names(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path`` and ``source_file`` of the files in a directory; no content is read."""
    return read_files(spark, path, pattern).select("path", "source_file")


def read_some(spark: SparkSession, path: str, pattern: str, chosen: DataFrame) -> DataFrame:
    """``read_files`` of the files whose ``path`` is in ``chosen``; no other file's content is read.

    Spark's driver holds a list of all files that a source reads, and so holds that of the chosen ones here.
    """
    paths = [r[0] for r in chosen.select("path").collect()]
    if not paths:
        return _named(spark.createDataFrame([], _FILE))
    empty = read_files(spark, path, pattern).where(F.col("length") == 0).join(chosen.select("path"), "path", "left_semi").select(*(f.split()[0] for f in _FILE.split(", ")), "source_file")
    found = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]).where(F.col("length") > 0)
    return _named(found).unionByName(empty)


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, modificationTime, length, content and ``source_file`` of the files in ``path`` itself; none if it is missing.

    Spark's source has no row for a file without a byte; such files are added from the directory's listing.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        listed = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern)) or []
        empty = [(f.getPath().toString(), f.getModificationTime() / 1000) for f in listed if f.isFile() and f.getLen() == 0]
        if empty:
            rows = spark.createDataFrame(empty, "path string, at double")
            files = files.unionByName(rows.select("path", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    else:
        files = spark.createDataFrame([], _FILE)
    return _named(files)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """The PDF files of a directory."""
    return read_files(spark, path, "*.pdf")


def is_pdf(path: str) -> Column:
    return F.lower(path).endswith(".pdf")


def read_texts(spark: SparkSession, path: str, *, exclude_metadata: bool = False) -> DataFrame:
    """``source_file`` and ``text`` of the text files of a directory, line ends as line feeds.

    Files of properties that lie beside them (``*_metadata.txt``) are read too, unless ``exclude_metadata``.
    """
    texts = texts_of(read_files(spark, path, "*.txt"))
    return texts.where(~F.col("source_file").endswith("_metadata.txt")) if exclude_metadata else texts


def texts_of(files: DataFrame) -> DataFrame:
    """``source_file`` and ``text`` of files, and why one couldn't be read where they say so."""
    why = [c for c in ("read_error",) if c in files.columns]
    return files.select("source_file", *why, F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))


def extract_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """``files`` without content, with ``pages``, ``properties`` and ``error``; a file that the extractor can't read has null pages."""
    kept = [f for f in files.schema.fields if f.name != "content"]
    properties = T.StructType([*(T.StructField(p, T.StringType()) for p in PROPERTIES), T.StructField("page_count", T.IntegerType())])
    out = T.StructType([*kept, T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("properties", properties), T.StructField("error", T.StringType())])
    kind = pa.struct([*((p, pa.string()) for p in PROPERTIES), ("page_count", pa.int32())])

    def run(batches):
        for batch in batches:
            pages, found, errors = [], [], []
            for content in batch.column("content").to_pylist():
                try:
                    own, named = extractor(content)
                    pages.append([str(p) for p in own])
                    found.append({p: str(named.get(p) or "") for p in PROPERTIES} | {"page_count": len(own)})
                    errors.append(None)
                except Exception as e:  # a bad file is a row that says so
                    pages.append(None)
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            made = [pa.array(pages, pa.list_(pa.string())), pa.array(found, kind), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=out.names)

    return files.mapInArrow(run, out)


def extract_text(files: DataFrame, extractor: Extractor) -> DataFrame:
    """``extract_pages`` with ``text``: the pages that aren't blank, joined by line ends."""
    return extract_pages(files, extractor).withColumn("text", join_pages(F.col("pages")))


def stems(spark: SparkSession, path: str, pattern: str, suffix: str = "") -> DataFrame:
    """Stems of the files in a directory, without ``suffix``; the content isn't read."""
    names = read_files(spark, path, pattern).select(stem(F.col("source_file")).alias("stem"))
    return names.select(F.regexp_replace("stem", f"{suffix}$", "").alias("stem")) if suffix else names


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``time - logger - level - message`` as ts, logger, level, message; other lines carry null and their message."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) - (\S+) - ([A-Z]+) - (.*)$"
    part = lambda k: F.nullif(F.regexp_extract("value", pattern, k), F.lit(""))
    message = F.when(part(1).isNull(), F.col("value")).otherwise(F.regexp_extract("value", pattern, 4))
    return spark.read.text(path).select(F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"), part(2).alias("logger"), part(3).alias("level"), message.alias("message"))
