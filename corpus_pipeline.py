"""From raw documents to packed training sequences, in five stages of the operators for training data.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``docs``, whatever their names. A stage's result is written before the next one reads it; ``run`` then deletes
what the stages up to it have written besides.

Cases, for each stage: an empty table gives no rows; null and empty texts are rejected by the language stage, and stay in
the others; a text of any length is read whole; of repeated rows one stays in the near-duplicate stage; rows without an
id are kept like others, and columns of any name are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import decontaminate, language, packing, passages, simhash
from folioweave.llm.common import materialise, only_result, table, written

ID, TEXT = "doc_id", "text"


def _wrapped(docs: DataFrame) -> DataFrame:
    """Id, text and the other columns, out of reach of the operators' own column names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (ID, TEXT)]
    return docs.select(ID, TEXT, F.struct(*rest, F.lit(True).alias("_")).alias("_rest"))


def _unwrapped(found: DataFrame, docs: DataFrame, **made: Column) -> DataFrame:
    """The columns of ``docs`` in their order; those of ``made`` have new values."""
    own = {c: made.get(c, F.col(c) if c in (ID, TEXT) else F.col(f"_rest.`{c}`")) for c in docs.columns}
    return found.select(*(value.alias(c) for c, value in own.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language (null, or without a letter), and names the language of rows without one.

    Nothing else hangs on the predictions: a language that a row has stays, also where the prediction is another one.
    Profiles are learnt from three quarters of the labelled texts.
    """
    names, prototypes = language.learn(docs.where(language.fold(ID, 4) != 2).select(ID, TEXT, "lang"))
    found = language.identify(_wrapped(docs), names, prototypes)
    if not names:
        return _unwrapped(found, docs)
    lang = F.col("_rest.lang")
    return _unwrapped(found.where(F.col("lang_pred") != language.UNKNOWN), docs, lang=F.when(lang.isNull(), F.col("lang_pred")).otherwise(lang))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the smallest id, the first of several; rows without an id come last.

    Rows are numbered in a table of their own, so a task that runs again can't number them otherwise.
    """
    rows = materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("_at")))
    key = F.struct(F.col(f"_row.{ID}").isNull().alias("none"), F.col(f"_row.{ID}").alias("id"), "_at")
    found = simhash.near_duplicates(rows.select(key.alias("_key"), F.col(f"_row.{TEXT}").alias(TEXT)), "_key", TEXT)
    stay = found.where(F.col("_key") == F.col("component_id")).select(F.col("_key._at").alias("_at"))
    return rows.join(stay, "_at", "left_semi").select("_row.*")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that an earlier document has; a text that loses nothing stays as it is."""
    found = passages.remove_repeats(_wrapped(docs), ID, TEXT)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col(TEXT))
    return _unwrapped(found, docs, text=text, n_chars=F.length(text).cast("long"))


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by the benchmark."""
    items = decontaminate.benchmark_items(table(spark, sf_dir, "benchmark", "item_id", "text"))
    found = decontaminate.judged(decontaminate.find(_wrapped(docs), items, TEXT))
    return _unwrapped(found.where(~F.col("contaminated")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packing.pack(docs.select(ID, TEXT), public_tokenizers.path("byte_bpe_50k.json"), TEXT)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_passages),
    ("decontamination", decontaminate_texts),
    ("packing", pack_sequences),
]

#: Fingerprints by XXH64 and token ids are beyond DuckDB's SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, began = table(spark, sf_dir, "documents", "*"), written()
    for _, stage in STAGES[:-1]:
        with only_result(spark, began) as write:
            docs = write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
