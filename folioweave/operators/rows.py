"""Arrays to rows, and the first rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def each(docs: DataFrame, values: Column | str, *keep: str, place: str, value: str) -> DataFrame:
    """``keep``, and a row for each of the array ``values`` with its ``place`` from 0.

    For a plain ``posexplode`` the optimiser infers a filter on the array's size, whose expression, with all Python in it,
    it then computes a second time below. It infers none for the outer form.
    """
    return docs.select(*keep, F.posexplode_outer(values).alias(place, value)).where(F.col(place).isNotNull())


def best(rows: DataFrame, by: list[str], order: tuple[Column, ...], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 0; a task passes on no more than its own first ``k``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("rank") < k)
