"""What the operators of this subpackage share: tables, durable intermediates, Arrow batches, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.sources.partitions import spread

#: A slice of a batch handed to an operator holds about so many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20
#: Keys with more rows than this, and more than this share of them, are looked up from a broadcast of at most 1 / share rows.
HOT_ROWS, HOT_SHARE = 1000, 1 / 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The whole table ``name``, with only ``columns``."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def handed(spark: SparkSession, value):
    """``value`` for the workers, as a function that gives it there.

    Its classes travel with it, as those of workers' functions do; those of a plain broadcast would have to be installed
    on executors. A worker unpacks it once for all its tasks.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def opened():
        if not hasattr(sent, "opened"):
            sent.opened = cloudpickle.loads(sent.value)
        return sent.opened

    return opened


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="folioweave-"))
    return context.getCheckpointDir()


#: Paths of the intermediate tables and checkpoints that this process has written and not deleted, in order.
_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder; unlike a table it keeps its partitioning."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append(file.get())
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written() -> int:
    """How many intermediates this process has written and not deleted."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Deletes all intermediates but the first ``since``: for when all results made of them are written."""
    delete(spark, _written[since:])
    del _written[since:]


@contextmanager
def only_result(spark: SparkSession, since: int):
    """Gives a function that writes a result; of the intermediates after the first ``since`` only such results stay."""
    results = []

    def write(df: DataFrame) -> DataFrame:
        out = materialise(df)
        results.append(_written.pop())
        return out

    yield write
    forget(spark, since)
    _written.extend(results)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's ``column`` has about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, text: str, fields: T.StructType, make: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """Adds ``fields`` to each row of ``df``; columns of the same names are replaced, all others are kept.

    ``make()`` runs once in a task and gives the function from a slice to the new columns, in order.
    """
    new = set(fields.names)
    kept = [f for f in df.schema.fields if f.name not in new]
    out = T.StructType([*kept, *fields.fields])
    names, keep = out.names, [f.name for f in kept]

    def run(batches):
        fn = make()
        for part in slices(batches, text, limit):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *fn(part)], names=names)

    return df.mapInArrow(run, out)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lookup(rows: DataFrame, found: DataFrame, key: str, counted: str) -> DataFrame:
    """``rows`` left-joined with ``found`` (one row for each ``key``, which ``counted`` of ``rows`` have) without skew.

    Keys that hold a large share of the rows, of which there can be 1 / HOT_SHARE at most, are broadcast; the other keys
    are joined by a shuffle, in which rows with a hot key or none are dealt over all tasks. ``found`` should be
    materialised. Null keys find nothing.
    """
    total = found.agg(F.sum(counted)).first()[0] or 0
    most = max(HOT_ROWS, int(total * HOT_SHARE))
    values = [c for c in found.columns if c not in (key, counted)]
    hot = found.where(F.col(counted) > most).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = found.where(F.col(counted) <= most).select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_salt"), F.struct(*values).alias("_cold"))
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    done = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    content = [c for c, kind in rows.dtypes if "map<" not in kind]
    joined = joined.withColumn("_salt", F.when(done, 1 + F.pmod(F.xxhash64(*content), F.lit(4093))).otherwise(F.lit(0).cast("long")))
    joined = joined.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values))
