"""The engine's functions by name in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioweave.functions.cleaning import REWRITES
from folioweave.functions.patterns import S
from folioweave.operators.recursive import METHOD, SEPARATORS, split_text


def _cleaned(text: str) -> str:
    for _, pattern, to in REWRITES:
        text = f"regexp_replace({text}, r'{pattern}', '{to.encode('unicode_escape').decode()}')"
    return f"regexp_replace({text}, r'^{S}+|{S}+\\z', '')"


#: Name, parameters, type and expression; they stay expressions of the plan that uses them.
FUNCTIONS = [
    ("clean_text", "t STRING", "STRING", _cleaned("coalesce(t, '')")),
    ("split_sentences", "t STRING", "ARRAY<STRING>", f"filter(transform(split(t, r'(?<=[.!?]){S}+'), s -> regexp_replace(s, r'^{S}+|{S}+\\z', '')), s -> length(s) > 0)"),
    ("l2_norm", "v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"),
    ("dot_product", "v ARRAY<DOUBLE>, w ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(v, w, (x, y) -> x * y), 0D, (a, x) -> a + x)"),
    ("sigmoid", "x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
]


class RecursiveChunks:
    """``recursive_chunks(text, size, overlap)``: a row for each chunk."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, str]]:
        import re

        if text is not None and overlap <= size:
            for k, chunk in enumerate(split_text(text, size, overlap, [re.escape(s) for s in SEPARATORS], len)):
                yield k, chunk, len(chunk), METHOD


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("recursive_chunks", udtf(RecursiveChunks, returnType="chunk_id int, text string, num_characters int, chunking_method string"))
