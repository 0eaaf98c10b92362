"""Registered queries of search: keywords, fusion, truncated vectors, diversity, re-ranking, and a collection's versions; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.operators import keywords, rerank, retrieval
from folioweave.queries import _D, _read
from folioweave.sources.collection import Collection
from folioweave.sources.store import scratch

TOP, DEEP, HEAD = 10, 50, 56


def _index(spark, sf_dir):
    return keywords.build(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _keywords(spark, sf_dir, k):
    """Searches a written index, which is read several times and outlives lost executors."""
    path = scratch(spark)
    _index(spark, sf_dir).save(path)
    return keywords.search(keywords.Index.load(spark, path), _read(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text", k)


def keyword_terms(spark, sf_dir):
    return _index(spark, sf_dir).terms


def keyword_search(spark, sf_dir):
    found = _keywords(spark, sf_dir, TOP)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def hybrid_search(spark, sf_dir):
    """Documents by keywords and by the vectors that have their ids; a benchmark item's vector is that of its id."""
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    asked = vectors.join(_read(spark, sf_dir, "benchmark", "item_id").distinct(), F.col("vec_id") == F.col("item_id"), "left_semi")
    near = retrieval.search(vectors, "embedding", "vec_id", asked, "embedding", "vec_id", DEEP).withColumnRenamed("vec_id", "key")
    found = keywords.fused({"words": _keywords(spark, sf_dir, DEEP), "vectors": near}, TOP, {"vectors": 0.5})
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "words", "vectors")


def _asked(vectors):
    return vectors.where(F.col("vec_id") % 20 == 0)


def truncated_search(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found, effort = retrieval.truncated_search(vectors, "embedding", "vec_id", _asked(vectors), "embedding", "vec_id", HEAD, 5)
    skipped = F.round(1 - F.col("scored") / F.col("chunks"), 4)
    return found.join(effort, "query").select("query", "rank", "vec_id", (F.round("score", 6) + F.lit(0.0)).alias("score"), "chunks", skipped.alias("skipped"))


def mmr_batch(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return retrieval.mmr_many(vectors, "embedding", "vec_id", _asked(vectors), "embedding", "vec_id").select("query", "rank", "vec_id")


def late_interaction(spark, sf_dir):
    """Vectors of one label are a chunk's sentences; a query is a vector and the two after it. Chunks of its first vector's 20 nearest are ranked anew."""
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    near = retrieval.search(vectors, "embedding", "vec_id", _asked(vectors), "embedding", "vec_id", 20)
    candidates = near.join(vectors.select("vec_id", F.col("label").alias("key")), "vec_id").select("query", "key")
    queries = vectors.where(F.col("vec_id") % 20 < 3).select((F.col("vec_id") - F.col("vec_id") % 20).alias("query"), F.col("embedding").alias("vector"))
    found = rerank.rerank_vectors(candidates, queries, vectors.select(F.col("label").alias("key"), F.col("embedding").alias("vector")), k=5)
    return found.select("query", "rank", F.col("key").cast("int").alias("label"), F.round("score", 6).alias("score"))


def collection_versions(spark, sf_dir):
    """The documents' sources: those of two thirds at first, then all added, the labelled ones updated, every seventh id put in or replaced, and the toxic ones deleted."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "source").withColumn("state", F.lit("first"))
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic").where("doc_id IS NOT NULL")
    held = Collection.create(docs.where("doc_id % 3 <> 0"), scratch(spark), "doc_id", 32)
    held.add(docs.withColumn("state", F.lit("added")))
    held.update(labels.select((F.col("doc_id") * 2).alias("doc_id"), F.lit("labelled").alias("state")).distinct())
    last = held.upsert(docs.where("doc_id % 7 = 0").select((F.col("doc_id") + 3).alias("doc_id"), F.lit("put").alias("state")))
    held.delete(labels.where("toxic = 1").select("doc_id"))
    rows = [held.read(v).withColumn("version", F.lit(v)) for v in (1, last, last + 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {f.__name__: f for f in (keyword_terms, keyword_search, hybrid_search, truncated_search, mmr_batch, late_interaction, collection_versions)}

_WORDS = f"""
        w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{keywords.TERM}')) AS term FROM documents WHERE doc_id IS NOT NULL),
        tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS times, sum(count(*)) OVER (PARTITION BY doc_id) AS length FROM w GROUP BY doc_id, term),
        df AS MATERIALIZED (SELECT term, count(*) AS docs FROM tf GROUP BY term)"""
_BM25 = f"""{_WORDS},
        size AS (SELECT count(DISTINCT doc_id) AS n, (SELECT sum(times) FROM tf) / count(DISTINCT doc_id) AS mean FROM documents),
        q AS (SELECT item_id, term, count(*) AS asked FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{keywords.TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
        parts AS (SELECT item_id, doc_id, CAST(round(asked * ln(1 + (n - docs + 0.5) / (docs + 0.5)) * CAST(times AS DOUBLE) * ({keywords.K1} + 1) / (CAST(times AS DOUBLE) + {keywords.K1} * (1 - {keywords.B} + {keywords.B} * length / mean)) * {keywords.UNIT}) AS BIGINT) AS part
                  FROM q JOIN df USING (term) JOIN tf USING (term), size),
        bm AS MATERIALIZED (SELECT item_id, doc_id, sum(part) AS s, CAST(row_number() OVER (PARTITION BY item_id ORDER BY sum(part) DESC, doc_id) - 1 AS INTEGER) AS rank FROM parts GROUP BY item_id, doc_id)"""
_NEAR = f"""
        v AS MATERIALIZED (SELECT vec_id, label, list_transform({_D}, lambda x: x / sqrt(list_inner_product({_D}, {_D}))) AS e FROM embeddings),
        p AS MATERIALIZED (SELECT q.vec_id AS query, v.vec_id, list_inner_product(q.e, v.e) AS s FROM v q, v WHERE {{which}}),
        near AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) - 1 AS INTEGER) AS rank FROM p)"""

ORACLES = {
    "keyword_terms": f"WITH {_WORDS} SELECT term, docs FROM df",
    "keyword_search": f"WITH {_BM25} SELECT item_id, rank, doc_id, round(CAST(s AS DOUBLE) / {keywords.UNIT}, 6) AS score FROM bm WHERE rank < {TOP}",
    "hybrid_search": f"""
        WITH {_BM25}, {_NEAR.format(which='q.vec_id IN (SELECT item_id FROM benchmark)')},
        ranks AS (SELECT item_id, doc_id, rank AS words, CAST(NULL AS INTEGER) AS vectors, 1.0::DOUBLE / ({keywords.RRF} + 1 + rank) AS part FROM bm WHERE rank < {DEEP}
                 UNION ALL SELECT query, vec_id, NULL, rank, 0.5::DOUBLE / ({keywords.RRF} + 1 + rank) FROM near WHERE rank < {DEEP}),
        s AS (SELECT item_id, doc_id, CAST(round(sum(part) * {keywords.UNIT}) AS BIGINT) AS s, max(words) AS words, max(vectors) AS vectors FROM ranks GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) - 1 AS INTEGER) AS rank, doc_id, round(s / {keywords.UNIT}::DOUBLE, 6) AS score, words, vectors FROM s QUALIFY rank < {TOP}""",
    "truncated_search": f"""
        WITH {_NEAR.format(which='q.vec_id % 20 = 0')},
        h AS MATERIALIZED (SELECT vec_id, e[1:{HEAD}] AS head, sqrt(list_inner_product(e[{HEAD + 1}:], e[{HEAD + 1}:])) AS tail FROM v),
        b AS MATERIALIZED (SELECT q.vec_id AS query, list_inner_product(q.head, h.head) AS s, q.tail * h.tail AS t FROM h q, h WHERE q.vec_id % 20 = 0),
        least AS (SELECT query, min(low) AS least FROM (SELECT query, s - t AS low, row_number() OVER (PARTITION BY query ORDER BY s - t DESC) AS n FROM b) WHERE n <= 5 GROUP BY query),
        effort AS (SELECT query, count(*) AS chunks, count(*) FILTER (s + t >= least - 1e-9) AS scored FROM b JOIN least USING (query) GROUP BY query)
        SELECT query, rank, vec_id, round(1 - s, 6) + 0.0::DOUBLE AS score, chunks, round(1 - scored / chunks, 4) AS skipped FROM near JOIN effort USING (query) WHERE rank < 5""",
    "mmr_batch": f"""
        WITH RECURSIVE {_NEAR.format(which='q.vec_id % 20 = 0')},
        c AS MATERIALIZED (SELECT query, vec_id, s, e FROM near JOIN v USING (vec_id) WHERE rank < 20),
        t AS MATERIALIZED (SELECT a.query, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.e, b.e) AS s FROM c a JOIN c b USING (query)),
        r AS (
            SELECT query, 0 AS rank, [vec_id] AS chosen FROM near WHERE rank = 0
            UNION ALL
            SELECT query, rank + 1, list_append(chosen, vec_id) FROM (
                SELECT r.query, r.rank, r.chosen, c.vec_id, row_number() OVER (PARTITION BY r.query ORDER BY round(0.5 * c.s - 0.5 * (SELECT max(t.s) FROM t WHERE t.query = r.query AND t.a = c.vec_id AND list_contains(r.chosen, t.b)), 12) DESC, c.s DESC, c.vec_id) AS n
                FROM r JOIN c ON c.query = r.query AND NOT list_contains(r.chosen, c.vec_id) WHERE r.rank < 3) WHERE n = 1)
        SELECT query, CAST(n - 1 AS INTEGER) AS rank, vec_id FROM (SELECT query, unnest(chosen) AS vec_id, unnest(range(1, 5)) AS n FROM r WHERE rank = 3)""",
    "late_interaction": f"""
        WITH {_NEAR.format(which='q.vec_id % 20 = 0')},
        c AS (SELECT DISTINCT query, label FROM near JOIN v USING (vec_id) WHERE rank < 20),
        m AS (SELECT c.query, c.label, a.vec_id, max(list_inner_product(a.e, b.e)) AS s FROM c JOIN v a ON a.vec_id - a.vec_id % 20 = c.query AND a.vec_id % 20 < 3 JOIN v b ON b.label = c.label GROUP BY ALL),
        t AS (SELECT query, label, sum(s) AS s FROM m GROUP BY ALL)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, label) - 1 AS INTEGER) AS rank, label, round(s, 6) AS score FROM t QUALIFY rank < 5""",
    "collection_versions": """
        WITH a AS (SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN 'first' ELSE 'added' END AS state FROM documents),
        u AS (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels WHERE doc_id IS NOT NULL),
        b AS (SELECT doc_id, CASE WHEN u.doc_id IS NULL THEN source END AS source, CASE WHEN u.doc_id IS NULL THEN state ELSE 'labelled' END AS state FROM a LEFT JOIN u USING (doc_id)),
        p AS (SELECT doc_id + 3 AS doc_id FROM documents WHERE doc_id % 7 = 0),
        c AS (SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM p) UNION ALL SELECT doc_id, NULL, 'put' FROM p)
        SELECT doc_id, source, state, 1 AS version FROM a UNION ALL SELECT doc_id, source, state, 3 FROM c
        UNION ALL SELECT doc_id, source, state, 4 FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)""",
}
