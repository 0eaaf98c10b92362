"""Files as rows, without a list of them on the driver.

A task lists a folder and gives a row for each file; tasks read the contents of whatever rows they get. So neither the
names nor the plan grow with the number of files on the driver, files without a byte are rows like others, and a filter or an
anti-join between listing and reading keeps files unread. Contents are dealt over partitions of about PARTITION bytes.

This reads by Arrow's file systems (local, HDFS, S3, GCS and what else ``readable`` finds); a store that only Spark knows is
read by ``files.read_files``.

Cases: a folder that isn't there has no files; folders within are left out; a file that goes between listing and
reading, or can't be read, has null content and an ``error``; names may hold any characters; a pattern is that of a shell and minds case.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a partition, and of a batch handed on.
PARTITION, BATCH = 128 << 20, 16 << 20
#: Rows of a batch of a listing.
LISTED = 10_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there; names aren't escaped in any way."""
    named = re.fullmatch("(?s)([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?(/.*)", path)
    if not named or named[1] == "file":
        return fs.LocalFileSystem(), named[3] if named else path
    store, root = fs.FileSystem.from_uri(f"{named[1]}:{named[2] or '//'}/")
    return store, root.rstrip("/") + named[3]


def readable(path: str) -> bool:
    """Whether Arrow knows the file system of ``path``."""
    try:
        _store(path)
    except (pa.ArrowInvalid, OSError, ImportError):
        return False
    return True


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``source_file``, ``modificationTime`` and ``length`` of the files in a folder itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                store, root = _store(folder)
                found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
                rows = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)]
                for a in range(0, len(rows), LISTED):
                    part = rows[a : a + LISTED]
                    times = [f.mtime or datetime.fromtimestamp(0, timezone.utc) for f in part]
                    columns = [[f"{folder.rstrip('/')}/{f.base_name}" for f in part], [f.base_name for f in part]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(times, pa.timestamp("us", "UTC")), pa.array([f.size for f in part], pa.int64())], names=["path", "source_file", "modificationTime", "length"])

    one = spark.createDataFrame([(path,)], "folder string").coalesce(1)
    return one.mapInArrow(run, "path string, source_file string, modificationTime timestamp, length long")


def contents(files: DataFrame) -> DataFrame:
    """``files`` (with ``path`` and ``length``) with ``content`` and ``error``, read where they lie after being dealt out."""
    size = files.agg(F.sum("length")).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    kept = [f for f in files.schema.fields if f.name not in ("content", "error")]
    names = [*(f.name for f in kept), "content", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, errors, first, size = [], [], 0, 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    store, name = _store(path)
                    with store.open_input_stream(name) as stream:
                        held.append(stream.read())
                    errors.append(None)
                except (OSError, pa.ArrowInvalid) as e:
                    held.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                size += len(held[-1] or b"")
                if size >= BATCH:
                    yield out(batch.slice(first, k + 1 - first), held, errors)
                    held, errors, first, size = [], [], k + 1, 0
            if held:
                yield out(batch.slice(first), held, errors)

    def out(rows: pa.RecordBatch, held: list, errors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), pa.array(held, pa.binary()), pa.array(errors, pa.string())], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "content binary", "error string"])
    return files.repartition(max(cores, -(-size // PARTITION))).mapInArrow(run, schema)
