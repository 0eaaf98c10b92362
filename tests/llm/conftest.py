import pytest
from pyspark.sql import functions as F

TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "Ein kurzer Text.",
    "Ein kurzer Text.",
    "12 34 --- !!",
    "\x00\x01 control ﻿ bytes ▁ <s> <|endoftext|>   x",
    "日本語のテキスト と English 混在 éÉß ñ",
    "word " * 60_000,
    "x" * 250_000,
]


@pytest.fixture
def awkward(spark):
    """Null and repeated ids, null, empty, odd, repeated and very long texts, and columns with the operators' own names."""
    rows = [(k if k not in (3, 4) else (None if k == 3 else 2), t, ["en", None, "de"][k % 3]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ("n_words", "n_tokens", "score", "fingerprint", "kept", "blk", "payload", "ids", "items", "vec", "answers0")
    return docs.withColumns({n: F.lit("own") for n in names})


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]
