"""Connected components of a graph that is held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import lookup, materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is connected with, for every node of ``links`` (``a``, ``b``, long).

    In each round every tree hooks on to the smallest root that a link joins it with, unless its own is smaller, paths
    are halved until all nodes hang from a root, and links inside a tree go. The rounds grow with the logarithm of the
    longest path. Each round's tables are written, so none depends on the rounds before it.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct())
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        hooks = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).groupBy("node").agg(F.min("up").alias("up"))
        hooks = _flat(materialise(hooks))
        edges = materialise(_moved(_moved(edges, hooks, "a"), hooks, "b").where("a <> b").distinct())
        labels = materialise(_moved(labels, hooks, "root"))
    return labels


def _flat(hooks: DataFrame) -> DataFrame:
    """Each node with the root at the end of its path."""
    while True:
        above = hooks.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        jump = hooks.join(above, F.col("up") == F.col("_node"), "left")
        jump = materialise(jump.select("node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")))
        hooks = jump.select("node", "up")
        if jump.where("moved").isEmpty():
            return hooks


def _moved(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """``rows`` with what ``column`` hangs from in its place; a root with very many rows is looked up without skew."""
    times = rows.groupBy(F.col(column).alias("node")).agg(F.count(F.lit(1)).alias("_times"))
    found = materialise(hooks.join(times, "node").select(F.col("node").alias(column), F.col("up").alias("_above"), "_times"))
    out = lookup(rows, found, column, "_times")
    return out.withColumn(column, F.coalesce("_above", column)).drop("_above")
