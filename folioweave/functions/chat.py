"""Conversations of assistants that think aloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions.cleaning import strip

END = "</think>"


def thinking(text: Column) -> Column:
    """What stands before the last end mark, without the start mark; empty if there is none."""
    at = F.length(text) - F.locate(END[::-1], F.reverse(text)) - len(END) + 2
    return F.when(F.instr(text, END) > 0, strip(F.regexp_replace(F.substring(text, F.lit(1), at - 1), "^\\s*<think>", ""))).otherwise("")


def content(text: Column) -> Column:
    """What stands after the last end mark; everything if there is none."""
    return strip(F.substring_index(text, END, -1))


def instruct(task: str, query: Column) -> Column:
    """A query with the instruction that goes before queries, not documents."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def history(turns: DataFrame) -> DataFrame:
    """Each conversation's turns in order, without what assistants thought (conv_id, turn, role, text)."""
    said = F.when(F.col("role") == "assistant", content(F.col("text"))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("text"))))
    return turns.groupBy("conv_id").agg(ordered.alias("messages"))


def think_switch(turns: DataFrame, default: bool = True) -> DataFrame:
    """Whether thinking is on at each turn: the latest user's ``/think`` or ``/no_think`` wins."""
    last = F.regexp_extract(F.col("text"), "(?s).*(/no_think|/think)\\b", 1)
    said = F.when((F.col("role") == "user") & (last != ""), last == "/think")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("thinking", F.coalesce(F.last(said, ignorenulls=True).over(so_far), F.lit(default)))
