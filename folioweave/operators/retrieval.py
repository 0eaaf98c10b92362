"""Search among embedded chunks.

One query is a literal of the plan, so each search is a scan with a top-k. ``search``, ``truncated_search`` and ``mmr_many``
answer tables of queries, in blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from folioweave.functions.vectors import cosine, l2_normalize, norm
from folioweave.operators.rows import best


#: Rows of a block; queries of it that are scored at once.
QUERIES = 4096
SLICE = 512


def as_vector(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def _where(chunks: DataFrame, equal: Mapping[str, object] | None) -> DataFrame:
    for column, value in (equal or {}).items():
        chunks = chunks.where(F.col(column) == value)
    return chunks


def similarity(chunks: DataFrame, vector: str, query: Sequence[float], into: str = "similarity") -> DataFrame:
    return chunks.withColumn(into, cosine(F.col(vector), as_vector(query)))


def top_k(chunks: DataFrame, vector: str, query: Sequence[float], key: str, k: int = 4, equal: Mapping[str, object] | None = None) -> DataFrame:
    """The ``k`` most similar rows that fulfil ``equal``, nearest first, with ``score``, a distance: lower is nearer."""
    found = similarity(_where(chunks, equal), vector, query)
    return found.orderBy(F.desc("similarity"), key).limit(k).withColumn("score", 1 - F.col("similarity")).drop("similarity")


def _blocks(rows: DataFrame, key: str, vector: str, name: str, size: int) -> DataFrame:
    """Rows whose vector isn't null, in blocks: arrays of keys and of all their vectors' numbers in a row."""
    held = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    keys, numbers = f"{name}_keys", f"{name}_vectors"

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("key").to_numpy()]), pa.array([part.column("vector").flatten().to_numpy()])], names=[keys, numbers])

    return held.mapInArrow(run, f"{keys} array<long>, {numbers} array<double>")


def _full(queries: DataFrame, key: str, vector: str) -> int:
    """Into how many partitions queries go so that each makes a whole block.

    Every partition of queries meets every one of chunks, and those are read anew for each. Few queries that lie in all partitions of
    a large table would otherwise read the table once for each of its own partitions.
    """
    return max(1, -(-queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).count() // QUERIES))


def _matrix(column: pa.Array, k: int, n: int) -> np.ndarray:
    return _unit(column[k].values.to_numpy().reshape(n, -1))


def search(chunks: DataFrame, vector: str, key: str, queries: DataFrame, query_vector: str, query_key: str, k: int = 4) -> DataFrame:
    """For each of ``queries`` the ``k`` most similar of ``chunks``: ``query_key`` as ``query``, ``rank`` from 0, ``key`` and ``score`` as in ``top_k``.

    Both are packed into blocks of QUERIES rows, and every block of queries meets every block of chunks, in one plan however
    many there are. Queries are dealt into whole blocks first, and chunks stream past them. A pair of blocks passes on its own ``k`` best of each query, so nothing but these is shuffled. Null vectors and keys are left
    out; keys are longs; equal scores go by key.
    """

    def nearest(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                names, keys = (batch.column(c)[j].values.to_numpy() for c in ("q_keys", "c_keys"))
                wanted, data = (_matrix(batch.column(c), j, len(n)) for c, n in (("q_vectors", names), ("c_vectors", keys)))
                order = np.argsort(keys, kind="stable")
                near = wanted @ data[order].T
                row, at = _best(near, k)
                yield _listed(names[row], keys[order][at], near[row, at])

    asked = queries.select(query_key, query_vector).repartition(_full(queries, query_key, query_vector))
    pairs = _blocks(chunks, key, vector, "c", QUERIES).crossJoin(_blocks(asked, query_key, query_vector, "q", QUERIES))
    return _ranked(pairs.mapInArrow(nearest, _FOUND), key, k)


_FOUND = "query long, similarity double, key long"


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of each row's ``k`` greatest values; of equal ones the first."""
    n = near.shape[1]
    if n > 4 * k:
        # all that reach the k-th greatest, which are few more than k; what is no number is last, as in a sort
        less = -near
        row, at = np.nonzero(~(less > np.partition(less, k - 1, axis=1)[:, k - 1, None]))
    else:
        row, at = np.nonzero(np.ones(near.shape, bool))
    order = np.lexsort((at, -near[row, at], row))
    row, at = row[order], at[order]
    own = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[own], at[own]


def _listed(names: np.ndarray, keys: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(near), pa.array(keys)], names=["query", "similarity", "key"])


def _found(names: np.ndarray, keys: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, keys.shape[1])), pa.array(near.ravel()), pa.array(keys.ravel())], names=["query", "similarity", "key"])


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    ranked = best(found, ["query"], (F.desc("similarity"), F.asc("key")), k)
    return ranked.select("query", "rank", F.col("key").alias(key), (1 - F.col("similarity")).alias("score"))


def truncated_search(chunks: DataFrame, vector: str, key: str, queries: DataFrame, query_vector: str, query_key: str, dimensions: int, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """What ``search`` gives, by exact scores of those chunks only that the first ``dimensions`` don't rule out; and for each query how many.

    A similarity lies within the product of both tails' lengths of what the first dimensions give. The first scan
    takes heads and tails' lengths alone: the ``k``-th greatest lower bound of a query, over all chunks, is a similarity
    that ``k`` chunks reach. The second scan scores a chunk only if its upper bound reaches that. The second table has
    ``query``, ``chunks`` and ``scored``. Both read what the second scan gives, which Spark keeps.
    """

    def unit(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).withColumn(column, l2_normalize(F.col(column)))

    def slim(rows: DataFrame, column: str) -> DataFrame:
        """Head and tail's length in place of the vector."""
        tail = F.slice(F.col(column), F.lit(dimensions + 1), F.greatest(F.size(column) - dimensions, F.lit(0)))
        return rows.withColumn(column, F.concat(F.slice(column, 1, dimensions), F.array(norm(tail))))

    def bounds(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                names, keys = (batch.column(c)[j].values.to_numpy() for c in ("q_keys", "c_keys"))
                wanted, data = (batch.column(c)[j].values.to_numpy().reshape(len(n), -1) for c, n in (("q_vectors", names), ("c_vectors", keys)))
                low = wanted[:, :-1] @ data[:, :-1].T - np.outer(wanted[:, -1], data[:, -1])
                found = np.argpartition(-low, min(k, low.shape[1]) - 1, axis=1)[:, :k]
                yield _found(names, keys[found], np.take_along_axis(low, found, axis=1))

    def scored(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                all_names, keys = (batch.column(c)[j].values.to_numpy() for c in ("q_keys", "c_keys"))
                asked_of, data = (batch.column(c)[j].values.to_numpy().reshape(len(n), -1) for c, n in (("q_vectors", all_names), ("c_vectors", keys)))
                for a in range(0, len(all_names), SLICE):
                    names, wanted, least = all_names[a : a + SLICE], asked_of[a : a + SLICE, :-1], asked_of[a : a + SLICE, -1]
                    head, tail = slice(None, dimensions), slice(dimensions, None)
                    high = wanted[:, head] @ data[:, head].T + np.outer(np.linalg.norm(wanted[:, tail], axis=1), np.linalg.norm(data[:, tail], axis=1))
                    # where most chunks are left, one product of all is cheaper than one for each query's own
                    kept = high >= least[:, None] - 1e-9
                    many = kept.sum(axis=1)
                    order = np.argsort(keys, kind="stable")
                    if many.sum() * 8 >= kept.size:
                        near = wanted @ data.T
                    else:
                        near = np.full(kept.shape, -np.inf)
                        for q in np.flatnonzero(many):
                            near[q, kept[q]] = data[kept[q]] @ wanted[q]
                    near[~kept] = -np.inf
                    row, at = _best(near[:, order], k)
                    value = near[row, order[at]]
                    row, at, value = (x[value > -np.inf] for x in (row, at, value))
                    n, m = len(row), len(names)
                    none = lambda size, kind: pa.nulls(size, kind)
                    both = lambda a, b: pa.concat_arrays([a, b])
                    yield pa.RecordBatch.from_arrays(
                        [both(pa.array(names[row]), pa.array(names)), both(pa.array(value), none(m, pa.float64())), both(pa.array(keys[order[at]]), none(m, pa.int64())), both(none(n, pa.int64()), pa.array(np.full(m, len(keys)))), both(none(n, pa.int64()), pa.array(many.astype(np.int64)))],
                        names=["query", "similarity", "key", "chunks", "scored"],
                    )

    parts = _full(queries, query_key, query_vector)
    asked, held = unit(queries.select(query_key, query_vector).repartition(parts), query_vector), unit(chunks, vector)
    low = _blocks(slim(held, vector), key, vector, "c", QUERIES).crossJoin(_blocks(slim(asked, query_vector), query_key, query_vector, "q", QUERIES)).mapInArrow(bounds, _FOUND)
    least = best(low, ["query"], (F.desc("similarity"), F.asc("key")), k).groupBy("query").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    # with fewer than k chunks nothing is ruled out
    least = least.select(F.col("query").alias(query_key), F.when(F.col("n") < k, -2.0).otherwise(F.col("least")).alias("_least"))
    asked = asked.join(least, query_key).repartition(parts)
    pairs = _blocks(asked.withColumn(query_vector, F.concat(query_vector, F.array("_least"))), query_key, query_vector, "q", QUERIES)
    found = _blocks(held, key, vector, "c", QUERIES).crossJoin(pairs).mapInArrow(scored, f"{_FOUND}, chunks long, scored long").persist(StorageLevel.MEMORY_AND_DISK)
    effort = found.where(F.col("chunks").isNotNull()).groupBy("query").agg(F.sum("chunks").alias("chunks"), F.sum("scored").alias("scored"))
    return _ranked(found.where(F.col("key").isNotNull()).select("query", "similarity", "key"), key, k), effort


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def above(chunks: DataFrame, vector: str, query: Sequence[float], threshold: float) -> DataFrame:
    """All rows with a similarity of at least ``threshold``."""
    return similarity(chunks, vector, query).where(F.col("similarity") >= threshold)


def _chosen(vectors: np.ndarray, wanted: np.ndarray, k: int, weight: float) -> list[int]:
    """Rows chosen in turn for nearness to the query and distance from those chosen; of values that differ by rounding only, the first."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(vectors)):
        repeat = (vectors @ vectors[chosen].T).max(axis=1) if chosen else np.zeros(len(vectors))
        value = np.round(weight * wanted - (1 - weight) * repeat, 12)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def mmr(chunks: DataFrame, vector: str, query: Sequence[float], key: str, k: int = 4, fetch_k: int = 20, weight: float = 0.5) -> DataFrame:
    """Of the ``fetch_k`` most similar rows ``k``, chosen in turn for nearness to the query and distance from those chosen.

    Adds ``rank`` from 0. Of values that differ by rounding only, the one nearest to the query is chosen. Only keys and vectors of ``fetch_k`` rows come to the driver.
    """
    near = top_k(chunks, vector, query, key, fetch_k).select(key, vector).collect()
    vectors = _unit(np.array([r[1] for r in near], np.float64).reshape(len(near), -1)) if near else np.zeros((0, 1))
    wanted = vectors @ _unit(np.array([query], np.float64))[0] if near else np.zeros(0)
    ranks = chunks.sparkSession.createDataFrame([(near[j][0], r) for r, j in enumerate(_chosen(vectors, wanted, k, weight))], f"{key} {dict(chunks.dtypes)[key]}, rank int")
    return chunks.join(F.broadcast(ranks), key).orderBy("rank")


def mmr_many(chunks: DataFrame, vector: str, key: str, queries: DataFrame, query_vector: str, query_key: str, k: int = 4, fetch_k: int = 20, weight: float = 0.5) -> DataFrame:
    """``mmr`` for each of ``queries``: ``query``, ``rank`` from 0, ``key`` and ``score`` (a distance). Each query's ``fetch_k`` candidates are one group; keys are longs."""
    near = search(chunks, vector, key, queries, query_vector, query_key, fetch_k).select("query", F.col("rank").alias("place"), F.col(key).alias("key"), "score")
    held = chunks.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.select(F.col(query_key).cast("long").alias("query"), F.col(query_vector).cast("array<double>").alias("wanted"))

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n = group.num_rows
        vectors, wanted = (_unit(group.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1)) for c in ("vector", "wanted"))
        chosen = _chosen(vectors, vectors @ wanted[0], k, weight)
        own = group.take(pa.array(chosen))
        return pa.table({"query": own.column("query"), "rank": pa.array(range(len(chosen)), pa.int32()), "key": own.column("key"), "score": own.column("score")})

    found = near.join(held, "key").join(asked, "query").groupBy("query").applyInArrow(choose, "query long, rank int, key long, score double")
    return found.withColumnRenamed("key", key)


def upsert(collection: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The collection with the rows of ``changes`` in place of those with their keys, and added to the others."""
    return collection.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(collection: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return collection.join(keys.select(key), key, "left_anti")
