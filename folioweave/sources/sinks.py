"""Writers."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.cleaning import stem
from folioweave.sources.files import PROPERTIES


def chunks_json(chunks: DataFrame, source: str, pretty: bool = True) -> DataFrame:
    """``source`` and ``json``, the array of its chunks in order, with nulls written out."""
    columns = [c for c in chunks.columns if c != source]
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    ordered = F.array_sort(F.collect_list(F.struct(*columns)))
    return chunks.groupBy(source).agg(F.to_json(ordered, options).alias("json"))


def arrays_json(docs: DataFrame, source: str, chunks: Column, pretty: bool = True) -> DataFrame:
    """``source`` and ``json`` of the array of structs ``chunks``, where the document lies; none for a null or empty array."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return docs.select(source, chunks.alias("_chunks")).where(F.size("_chunks") > 0).select(source, F.to_json("_chunks", options).alias("json"))


def write_chunks(chunks: DataFrame, path: str, *, format: str = "json", source: str = "source_file", mode: str = "overwrite") -> None:
    """Chunks as lines or columns, a directory for each source; only the sources that are written are replaced."""
    chunks.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy(source).format(format).save(path)


def write_texts(texts: DataFrame, path: str, *, source: str = "source_file", mode: str = "overwrite") -> None:
    """Cleaned texts as Parquet, keyed by the source's stem."""
    texts.select(F.col(source), stem(F.col(source)).alias("stem"), "text").write.mode(mode).parquet(path)


def write_files(files: DataFrame, path: str) -> int:
    """A file in ``path`` for each row of ``name`` and ``content`` (text); how many. Executors write them, so the folder must be one that they share.

    A file is written beside its place and then moved, so none is ever there in part.
    """

    def run(batches):
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            attempt = TaskContext.get().taskAttemptId()
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{root}/.{name}.{attempt}"
                with store.open_output_stream(part) as out:
                    out.write((content or "").encode())
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path if re.match("[a-z0-9]+:/", path) else str(Path(path).absolute()))
    return store, root.rstrip("/")


def chunk_files(chunks: DataFrame, source: str = "source_file") -> DataFrame:
    """``name`` and ``content`` of a file of chunks for each source."""
    return chunks_json(chunks, source).select(F.concat(stem(F.col(source)), F.lit("_chunks.json")).alias("name"), F.col("json").alias("content"))


def text_files(texts: DataFrame, source: str = "source_file") -> DataFrame:
    """``name`` and ``content`` of a file for each text, and of one for its properties if ``texts`` has them as ``metadata_text``."""
    own = stem(F.col(source))
    out = texts.select(F.concat(own, F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    if "metadata_text" not in texts.columns:
        return out
    return out.unionByName(texts.select(F.concat(own, F.lit("_metadata.txt")).alias("name"), F.concat("metadata_text", F.lit("\n")).alias("content")))


def properties_text(properties: Column) -> Column:
    """``key: value`` lines; a file of them ends with a line's end, too."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{p}: "), F.coalesce(properties[p].cast("string"), F.lit(""))) for p in (*PROPERTIES, "page_count")))
