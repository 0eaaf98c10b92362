"""Partitions of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of less than this for each core is small.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt over all of them; any other as it is.

    So few partitions hold a few hundred MB at most, and what is computed from their rows costs far more than moving them.
    A small table's partitions can be empty for the most part, as a file's group of rows is never split, so one of up to
    twice as many is dealt out too.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    small = parts < 2 * cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL * cores
    return df.repartition(cores) if parts < cores or small else df
