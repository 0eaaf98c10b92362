"""A second stage over a first one's candidates: late interaction of sentence vectors, or any other score.

A candidate's score is the sum, over the query's sentences, of the best match among the chunk's sentences. Each candidate is one
row with both sets of vectors, scored by built-in functions; queries are groups of the last ranking only.

``rerank_vectors`` gives late interaction of chunks of any size, from tables with a row for each vector: blocks of queries meet blocks
of vectors, sorted by chunk, as in ``retrieval.search``, and only the best match of each query's vector in a block's part of a
candidate is shuffled. No row holds a chunk's or a query's whole set.

Cases: a candidate whose query or chunk isn't there, or has null vectors, is dropped; one with an empty set of sentences
scores 0 for each of the query's; repeated candidates count once; equal scores go by key. Of tables of vectors, null ones are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.vectors import bound, dot, l2_normalize
from folioweave.operators.retrieval import QUERIES, _blocks, _matrix
from folioweave.operators.rows import best


def late_interaction(query: Column, chunk: Column) -> Column:
    """Sum of the best cosines of each vector of ``query`` among those of ``chunk``."""
    unit = lambda vs: F.transform(vs, l2_normalize)
    nearest = lambda q, vs: F.coalesce(F.array_max(F.transform(vs, lambda v: dot(q, v))), F.lit(0.0))
    return bound(unit(chunk), lambda vs: F.aggregate(F.transform(unit(query), lambda q: nearest(q, vs)), F.lit(0.0), lambda a, x: a + x))


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, *, query_vectors: str = "vectors", chunk_vectors: str = "vectors", k: int = 4, score: Callable[[Column, Column], Column] = late_interaction) -> DataFrame:
    """The ``k`` best of each query's ``candidates`` (query, key): ``query``, ``rank`` from 0, ``key`` and ``score`` (higher is better).

    ``queries`` has ``query``, ``chunks`` has ``key``; ``score`` makes a column of both sides' columns, by a model's
    pandas function as well as by built-in ones.
    """
    asked = queries.where(F.col(query_vectors).isNotNull()).select("query", F.col(query_vectors).alias("_asked"))
    held = chunks.where(F.col(chunk_vectors).isNotNull()).select("key", F.col(chunk_vectors).alias("_held"))
    rows = candidates.select("query", "key").distinct().join(held, "key").join(asked, "query")
    found = rows.select("query", "key", score(F.col("_asked"), F.col("_held")).alias("score"))
    return best(found, ["query"], (F.desc("score"), F.asc("key")), k).select("query", "rank", "key", "score")


def rerank_vectors(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, *, vector: str = "vector", k: int = 4) -> DataFrame:
    """What ``rerank`` gives by late interaction, of ``queries`` (``query``, ``vector``) and ``chunks`` (``key``, ``vector``) with a row for each vector.

    Queries and keys are longs. The work is that of the queries' vectors times the chunks'; a block of vectors none of whose
    chunks is a candidate of a block's queries is passed over.
    """
    wanted = candidates.select(F.col("query").cast("long").alias("query"), F.col("key").cast("long").alias("key")).groupBy("query").agg(F.sort_array(F.collect_set("key")).alias("_wanted"))
    held = queries.where(F.col(vector).isNotNull()).select(F.col("query").cast("long").alias("query"), F.monotonically_increasing_id().alias("_place"), F.col(vector).cast("array<double>").alias("_vector"))

    def packed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                lists, numbers = part.column("_wanted"), part.column("_vector")
                columns = [part.column("query"), part.column("_place"), lists.flatten(), lists.value_lengths().cast(pa.int32()), numbers.flatten()]
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False)]) for c in columns], names=["q_names", "q_places", "q_wanted", "q_sizes", "q_vectors"])

    asked = held.join(wanted, "query").mapInArrow(packed, "q_names array<long>, q_places array<long>, q_wanted array<long>, q_sizes array<int>, q_vectors array<double>")

    def nearest(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                names, places, keys, sizes, of = (batch.column(c)[j].values.to_numpy() for c in ("q_names", "q_places", "q_wanted", "q_sizes", "c_keys"))
                if not np.isin(of, keys).any():
                    continue
                order = np.argsort(of, kind="stable")
                own, first = np.unique(of[order], return_index=True)
                data = _matrix(batch.column("c_vectors"), j, len(of))[order]
                near = np.maximum.reduceat(_matrix(batch.column("q_vectors"), j, len(names)) @ data.T, first, axis=1)
                # a candidate is where its query's row and its key's column meet
                row, at = np.repeat(np.arange(len(names)), sizes), np.minimum(np.searchsorted(own, keys), len(own) - 1)
                here = own[at] == keys
                row, at = row[here], at[here]
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(own[at]), pa.array(places[row]), pa.array(near[row, at])], names=["query", "key", "place", "near"])

    data = _blocks(chunks.where(F.col(vector).isNotNull()).sortWithinPartitions("key"), "key", vector, "c", QUERIES)
    near = asked.crossJoin(data).mapInArrow(nearest, "query long, key long, place long, near double")
    found = near.groupBy("query", "key", "place").agg(F.max("near").alias("near")).groupBy("query", "key").agg(F.sum("near").alias("score"))
    # equal vectors may differ in the last bits by where they lie in a block
    return best(found, ["query"], (F.round("score", 12).desc(), F.asc("key")), k).select("query", "rank", "key", "score")
