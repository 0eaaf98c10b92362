"""The latest content of files that arrive again and again, by state that is kept for each file name.

A stream of deliveries holds files under the same names in folder after folder. ``changed`` keeps of each name the
time and the hash of what it last saw: content that is the same, or older than what is there, adds nothing; new content is
passed on under the next version. So chunks are made once for each change, however often a file comes and the query is restarted.
``write`` appends them; ``current`` reads each file's last version, in which a file that has become blank has no chunks.

State is one small row for each name, in RocksDB on the executors and in the checkpoint. ``sessions`` and ``arriving.per_interval`` count
deliveries behind a watermark; what comes later than that is left out.

Cases: of files of one name in one batch the newest decides, of equally new ones the one with the greatest hash; a null name is a name; null
content is like an empty one, a version without chunks; a stream without files writes nothing;
Spark's source has no row for a file without a byte, so what hides a file's chunks is one with white space alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioweave.functions.cleaning import clean_text
from folioweave.operators import recursive

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSIONS = "source_file string, version long, arrived timestamp, text string"


class _Latest(StatefulProcessor):
    """Passes a name's content on when it is another and newer one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long, hash string, version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, held, version = self.seen.get() if self.seen.exists() else (None, None, 0)
        at, found, newest = max(((r["at"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r) for r in rows), key=lambda r: r[:2])
        if before is not None and (at, found) <= (before, held):
            return
        self.seen.update((at, found, version + (found != held)))
        if found != held:
            yield Row(source_file=key[0], version=version + 1, arrived=newest["arrived"], text=newest["text"])

    def close(self) -> None:
        pass


def changed(texts: DataFrame) -> DataFrame:
    """Of a stream of ``source_file``, ``text`` and ``arrived`` the contents that are new, with their ``version`` from 1."""
    texts = texts.withColumn("at", F.coalesce(F.unix_micros("arrived"), F.lit(0).cast("long")))
    return texts.groupBy("source_file").transformWithState(_Latest(), VERSIONS, "Append", "None")


def clean_and_chunk(versions: DataFrame, *, chunk_size: int = 1000, chunk_overlap: int = 200) -> DataFrame:
    """Chunks of each version; one without any has a row without ``chunk_id`` and ``text``, which hides the versions before."""
    cleaned = versions.withColumn("chunks", recursive.split(clean_text(F.coalesce("text", F.lit(""))), chunk_size=chunk_size, chunk_overlap=chunk_overlap))
    return cleaned.select("source_file", "version", "arrived", F.posexplode_outer("chunks").alias("chunk_id", "text"))


def write(chunks: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks to a Parquet table, exactly once, and ends when all that is there has been read."""
    spark = chunks.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the query has a session of its own from its start on
    try:
        return chunks.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of each file's last version. Versions are few for a file, so the last is found by partial maxima, which are small."""
    rows = spark.read.parquet(output)
    last = rows.groupBy("source_file").agg(F.max("version").alias("version"))
    return rows.where(F.col("chunk_id").isNotNull()).join(last.withColumnRenamed("source_file", "_name"), F.col("source_file").eqNullSafe(F.col("_name")) & (rows["version"] == last["version"])).select(*(rows[c] for c in rows.columns))


def sessions(texts: DataFrame, *, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Deliveries of each file that follow one another by less than ``gap``: their window and number; later ones than ``late`` are left out."""
    return texts.withWatermark("arrived", late).groupBy("source_file", F.session_window("arrived", gap).alias("session")).agg(F.count(F.lit(1)).alias("deliveries"))
