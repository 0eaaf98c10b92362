"""Keyword search by an inverted index, and its fusion with other rankings.

The index lies in blocks of documents, as they are read: a row holds the keys and lengths of at most BLOCK bytes of text and, for
each term, which of these documents have it and how often. A block is made by the task that reads the texts, so nothing is shuffled, and its size
is bounded, so a term that every document has is many short runs. An index can be written and read again. Only where keys repeat, terms
are first added up by key, through a shuffle.

``search`` has blocks of queries meet all blocks of documents by Spark's own product of two tables, twice: the first time it counts the documents that hold
the queries' terms, and the second time it sums BM25 parts. All of a document's terms are in its block, so sums are complete there, and
a block passes on only its ``k`` best of each query. Parts are rounded to 1e-9 and summed as whole numbers, so
results don't hang on the order of tasks.

Cases: null or blank texts have no terms and are never found, nor do such queries find anything, but they count as documents; of documents
repeated under one key the terms are added up; a query's repeated terms count each; equal scores go by key; documents or queries without a key take no part;
an empty index finds nothing. Keys of documents and queries may be of any type that can be ordered. A single text is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from folioweave.operators.rows import best

#: Terms are runs of letters and digits, in lower case, told by RE2; what stands between them.
TERM = r"[\p{L}\p{Nd}]+"
BETWEEN = r"[^\p{L}\p{Nd}]+"
#: Documents of a block at most, and its bytes of text; BM25's saturation and weight of lengths; parts of a score are whole multiples of 1 / UNIT.
SLOT, BLOCK, K1, B, UNIT = 4096, 1 << 20, 1.2, 0.75, 1_000_000_000
#: The share of a block's documents from which a term is scored once for all queries; the others are scored together.
FREQUENT = 0.05
#: Queries of a block; query terms of a partition; parts that are computed at once.
QUERIES, ASKED, PARTS = 512, 1 << 20, 1 << 17
#: The constant of reciprocal ranks.
RRF = 60


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each of some lower-case texts without nulls."""
    split = pc.split_pattern_regex(texts, pattern=BETWEEN)
    flat, n = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    own = np.bincount(np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)], minlength=len(n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), flat.filter(full))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists without nulls, and all their values."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _row(fields: T.StructType, *arrays) -> pa.RecordBatch:
    """One row of lists."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a)) for a in arrays]
    return pa.RecordBatch.from_arrays(lists, names=fields.names)


def _cuts(sizes: np.ndarray, limit: int, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges that sum to about ``limit`` at most, of ``most`` items at most."""
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        step = most or max(1, b - a)
        yield from ((c, min(b, c + step)) for c in range(a, b, step))


def _fields(key: T.DataType) -> T.StructType:
    parts = {"keys": key, "lengths": T.LongType(), "terms": T.StringType(), "docs": T.IntegerType(), "places": T.IntegerType(), "times": T.LongType()}
    return T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in parts.items()])


def _block(fields: T.StructType, keys: pa.Array, terms: pa.ListArray, times: np.ndarray | None) -> pa.RecordBatch:
    """Documents with their terms, which occur once each time or ``times``, as one row of the index."""
    n, (own, flat) = len(keys), _lists(terms)
    coded = flat.dictionary_encode()
    pair = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), own)
    if times is None:
        pair.sort()
    else:
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    times = np.diff(first, append=len(pair)) if times is None else np.add.reduceat(times, first) if len(first) else times
    term, place = np.divmod(pair[first], n)
    lengths = np.zeros(n, np.int64)
    np.add.at(lengths, place, times)
    docs = np.bincount(term, minlength=len(coded.dictionary))
    return _row(fields, keys, lengths, coded.dictionary, docs.astype(np.int32), place.astype(np.int32), times.astype(np.int64))


@dataclass
class Index:
    """``blocks``: ``keys`` and ``lengths`` of documents, ``by_key``, their order by key; ``terms``, the number of ``docs`` that hold each, and for these, term by term, ``places`` and ``times``. And the number of documents."""

    blocks: DataFrame
    documents: int

    @cached_property
    def words(self) -> int:
        """The number of all words."""
        return self.blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0

    @property
    def terms(self) -> DataFrame:
        """``term`` and its number of ``docs``."""
        return self.blocks.select(F.inline(F.arrays_zip("terms", "docs")).alias("term", "docs")).groupBy("term").agg(F.sum("docs").cast("long").alias("docs"))

    @property
    def postings(self) -> DataFrame:
        """``term`` and ``docs`` (key, times, length) of each block."""
        kind = self.blocks.schema["keys"].dataType.elementType
        doc = T.StructType([T.StructField("key", kind), T.StructField("times", T.LongType()), T.StructField("length", T.LongType())])

        def run(batches):
            for batch in batches:
                for j in range(batch.num_rows):
                    keys, lengths, terms, docs, places, times = (batch.column(c)[j].values for c in ("keys", "lengths", "terms", "docs", "places", "times"))
                    held = pa.StructArray.from_arrays([keys.take(places), times, lengths.take(places)], names=["key", "times", "length"])
                    ends = np.concatenate([[0], np.cumsum(docs.to_numpy())])
                    yield pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], names=["term", "docs"])

        return self.blocks.mapInArrow(run, T.StructType([T.StructField("term", T.StringType()), T.StructField("docs", T.ArrayType(doc))]))

    def save(self, path: str) -> None:
        """Writes the index, in small groups of rows, as readers hold a group; words are counted from what is written, so texts are read once."""
        spark = self.blocks.sparkSession
        small = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "compression": "zstd"}
        self.blocks.write.mode("overwrite").options(**small).parquet(f"{path}/blocks")
        words = Index(spark.read.parquet(f"{path}/blocks"), self.documents).words
        spark.createDataFrame([(self.documents, words)], "documents long, words long").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        size = spark.read.parquet(f"{path}/size").first()
        index = Index(spark.read.parquet(f"{path}/blocks"), size["documents"])
        index.words = size["words"]
        return index


def build(docs: DataFrame, key: str, text: str, slot: int = SLOT) -> Index:
    """The index of ``docs``."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    n, documents = rows.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    fields = _fields(rows.schema["key"].dataType)

    def of_texts(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _cuts(sizes, BLOCK, slot):
                yield _block(fields, batch.column("key").slice(a, b - a), terms_of(batch.column("text").slice(a, b - a)), None)

    def of_counts(batches):
        for batch in batches:
            sizes, _ = _lists(batch.column("terms"))
            for a, b in _cuts(sizes, BLOCK // 8, slot):
                terms, (_, times) = batch.column("terms").slice(a, b - a), _lists(batch.column("times").slice(a, b - a))
                yield _block(fields, batch.column("key").slice(a, b - a), terms, times.to_numpy())

    blocks = rows.mapInArrow(of_texts, fields)
    if n != documents:
        each = Index(blocks, n).postings.select("term", F.inline("docs")).groupBy("key", "term").agg(F.sum("times").alias("times"))
        whole = each.groupBy("key").agg(F.collect_list(F.struct("term", "times")).alias("t")).select("key", F.col("t.term").alias("terms"), F.col("t.times").alias("times"))
        blocks = whole.mapInArrow(of_counts, fields)
    order = F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
    return Index(blocks.withColumn("by_key", F.transform(order, lambda x: x["at"])), documents)


def _asked(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``query``, ``term`` and how often it is ``asked``."""
    rows = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("query"), terms_of(batch.column("text"))], names=["query", "terms"])

    split = rows.mapInArrow(run, T.StructType([T.StructField("query", rows.schema["query"].dataType), T.StructField("terms", T.ArrayType(T.StringType()))]))
    return split.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("asked"))


def _packed(rows: DataFrame, fields: T.StructType, make: Callable) -> DataFrame:
    """Rows of arrays that ``make`` gives for slices of QUERIES rows."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                yield _row(fields, *make(batch.slice(a, QUERIES)))

    return rows.mapInArrow(run, fields)


def _scores(q_names, q_at, q_terms, q_weights, keys, lengths, by_key, terms, docs, places, times, mean: float, k: int, k1: float, b: float) -> pa.RecordBatch:
    """The ``k`` best of a block of documents for each of a block of queries."""
    n = len(keys)
    by_key, docs = by_key.to_numpy(), docs.to_numpy().astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[by_key] = np.arange(n)
    # documents by key from here on
    times, at, starts = times.to_numpy().astype(np.float64), rank[places.to_numpy()], np.cumsum(docs) - docs
    size = times + k1 * (1 - b + b * lengths.to_numpy().take(by_key)[at].astype(np.float64) / mean)
    term = pc.fill_null(pc.index_in(q_terms, value_set=terms), -1).to_numpy(zero_copy_only=False)
    here = np.flatnonzero(term >= 0)
    term, who, weight = term[here], q_at.to_numpy()[here], q_weights.to_numpy()[here]
    sums, nothing = np.zeros((len(q_names), n), np.int64), []

    def parts(weight, i):
        return np.floor(weight * times[i] * (k1 + 1) / size[i] * UNIT + 0.5).astype(np.int64)

    often = docs[term] > FREQUENT * n
    rare = np.flatnonzero(~often)
    for a, z in _cuts(docs[term[rare]], PARTS):
        some = rare[a:z]
        m = docs[term[some]]
        i = np.repeat(starts[term[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        part, q, d = parts(np.repeat(weight[some], m), i), np.repeat(who[some], m), at[i]
        np.add.at(sums, (q, d), part)
        nothing.append((q[part == 0], d[part == 0]))
    often = np.flatnonzero(often)
    often = often[np.lexsort((weight[often], term[often]))]
    new = np.flatnonzero((np.diff(term[often], prepend=-1) != 0) | (np.diff(weight[often], prepend=-1) != 0))
    for a, z in zip(new, [*new[1:], len(often)], strict=False):
        t = term[often[a]]
        i = slice(starts[t], starts[t] + docs[t])
        part, q = parts(weight[often[a]], i), who[often[a:z]]
        sums[q[:, None], at[i]] += part
        if not part.all():
            none = at[i][part == 0]
            nothing.append((np.repeat(q, len(none)), np.tile(none, len(q))))
    # what holds a term is found, also where its parts are rounded to nothing
    found = sums > 0
    for q, d in nothing:
        found[q, d] = True
    sums[~found] = -1
    least = np.maximum(np.partition(sums, n - k, axis=1)[:, n - k], 0) if n > k else np.zeros(len(q_names), np.int64)
    q, d = np.nonzero(sums >= least[:, None])
    order = np.lexsort((d, -sums[q, d], q))
    q, d = q[order], d[order]
    own = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, d = q[own], d[own]
    return pa.RecordBatch.from_arrays([q_names.take(pa.array(q)), keys.take(pa.array(by_key[d])), pa.array(sums[q, d])], names=["query", "key", "sum"])


def search(index: Index, queries: DataFrame, key: str, text: str, k: int = 4, k1: float = K1, b: float = B) -> DataFrame:
    """For each of ``queries`` the ``k`` best documents by BM25: ``query``, ``rank`` from 0, ``key`` and ``score`` (higher is better)."""
    asked = _asked(queries, key, text).persist(StorageLevel.MEMORY_AND_DISK)
    parts, mean = max(1, -(-asked.count() // ASKED)), index.words / index.documents if index.words else 1.0
    name = asked.schema["query"].dataType

    def held(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                wanted, terms, docs = (batch.column(c)[j].values for c in ("wanted", "terms", "docs"))
                at = pc.index_in(wanted, value_set=terms)
                yield pa.RecordBatch.from_arrays([wanted.filter(at.is_valid()), docs.take(at.drop_null())], names=["term", "docs"])

    def scored(batches):
        columns = ("q_names", "q_at", "q_terms", "q_weights", "keys", "lengths", "by_key", "terms", "docs", "places", "times")
        for batch in batches:
            for j in range(batch.num_rows):
                yield _scores(*(batch.column(c)[j].values for c in columns), mean, k, k1, b)

    wanted = _packed(asked.select("term").distinct().coalesce(parts), T.StructType([T.StructField("wanted", T.ArrayType(T.StringType()))]), lambda batch: [batch.column("term")])
    df = index.blocks.select("terms", "docs").crossJoin(wanted.persist(StorageLevel.MEMORY_AND_DISK)).mapInArrow(held, "term string, docs int").groupBy("term").agg(F.sum("docs").alias("df"))
    rarity = F.ln(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").groupBy("query").agg(F.collect_list(F.struct("term", (F.col("asked") * rarity).alias("weight"))).alias("t"))

    def query_block(batch):
        n, terms = _lists(batch.column("terms"))
        return batch.column("query"), np.repeat(np.arange(len(n)), n), terms, batch.column("weights").flatten()

    kinds = {"q_names": name, "q_at": T.LongType(), "q_terms": T.StringType(), "q_weights": T.DoubleType()}
    blocks = _packed(weighed.select("query", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")).coalesce(parts), T.StructType([T.StructField(c, T.ArrayType(kind)) for c, kind in kinds.items()]), query_block)
    out = T.StructType([T.StructField("query", name), T.StructField("key", index.blocks.schema["keys"].dataType.elementType), T.StructField("sum", T.LongType())])
    found = index.blocks.crossJoin(blocks.persist(StorageLevel.MEMORY_AND_DISK)).mapInArrow(scored, out)
    return best(found, ["query"], (F.desc("sum"), F.asc("key")), k).select("query", "rank", "key", (F.col("sum") / UNIT).alias("score"))


def fused(rankings: dict[str, DataFrame], k: int = 4, weights: dict[str, float] | None = None, constant: int = RRF) -> DataFrame:
    """Rankings (query, key, rank from 0) as one, by the weighted sum of reciprocal ranks.

    Gives ``query``, ``rank``, ``key``, ``score`` and each ranking's own rank under its name, null where it doesn't have the key.
    """
    out = None
    for name, ranking in rankings.items():
        part = ranking.select("query", "key", F.lit(name).alias("_of"), "rank", (F.lit((weights or {}).get(name, 1.0)) / (constant + 1 + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    sums = out.groupBy("query", "key").agg(F.round(F.sum("part") * UNIT).cast("long").alias("sum"), *(F.max(F.when(F.col("_of") == name, F.col("rank"))).alias(name) for name in rankings))
    return best(sums, ["query"], (F.desc("sum"), F.asc("key")), k).select("query", "rank", "key", (F.col("sum") / UNIT).alias("score"), *rankings)
