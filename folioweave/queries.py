"""The registered queries of the engine's own operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import chat, cleaning, vectors
from folioweave.functions.patterns import DIGIT, S, re2
from folioweave.operators import elements, embed, incremental, maxmin, recursive, retrieval, sentences
from folioweave.operators.rows import each
from folioweave.sources.partitions import spread
from folioweave.sources.sinks import arrays_json

#: Lines that make the cleaner work: (k, r, text) goes to documents whose id leaves r when divided by k.
NOISE = [
    (3, 0, "Page 12\n\n\nHalaman 3 of 9\n7 of 20 dan page 5"),
    (4, 1, "lihat https://contoh.id/a/b?c=1&d=[2]~e dan surel info@contoh.co.id segera"),
    (5, 2, "• butir satu\n● butir dua\n  - butir tiga\n-5.2 persen"),
    (6, 3, "© 2024 Contoh\nCopyright © 2023 Contoh\nCopyright 2022 semua hak\nbaris"),
    (7, 4, "[12]\n345\n---\n___ ===\nteks [3] dengan (45) catatan..... selesai----ya"),
    (8, 5, "kolom\ta \t b   c  \nkalimat pertama,\nlanjut kata\na\nb\nc\nlagi;\nterus"),
    (9, 6, "﻿nol​lebar\x07kontrol\u0085x  \n　 kosong"),
    (10, 7, "Badan Pusat Statistik RI\nKATALOG BPS: 1101001\nISSN 0126: 2912\nisi tabel\n\n\n\nwww.bps.go.id/x"),
]
VECTOR, LOW, DIMENSIONS, TOP, FLOOR = 0, 0.05, 16, 10, 0.2


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return spread(rows) if {"text", "html"} & set(columns) else rows


def noised(docs: DataFrame) -> DataFrame:
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", F.concat(text, *(F.when(F.pmod("doc_id", F.lit(k)) == r, "\n" + x).otherwise("") for k, r, x in NOISE)))


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noised(_read(spark, sf_dir, "documents", "doc_id", "text"))


def _fingerprint(text: Column | str) -> Column:
    """A text's hash, to compare long texts by."""
    return F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def clean_documents(spark, sf_dir):
    docs = _noisy(spark, sf_dir).withColumn("cleaned", cleaning.clean_text(F.col("text")))
    return docs.select("doc_id", F.length("text").alias("n_before"), F.length("cleaned").alias("n_after"), "cleaned")


def clean_plain_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", cleaning.clean_text(F.col("text")).alias("cleaned"))


def clean_reduction_stats(spark, sf_dir):
    docs = _noisy(spark, sf_dir).withColumn("cleaned", cleaning.clean_text(F.col("text")))
    return docs.select("doc_id", F.round(cleaning.reduction_percent(F.col("text"), F.col("cleaned")), 6).alias("reduction_percent"))


def clean_advanced_numbers(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", _fingerprint(cleaning.clean_text_advanced(F.col("text"), remove_numbers=True)).alias("cleaned_md5"))


def clean_advanced_punct(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", _fingerprint(cleaning.clean_text_advanced(F.col("text"), remove_punctuation=True)).alias("cleaned_md5"))


def remove_headers(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", _fingerprint(cleaning.remove_headers_footers(F.col("text"))).alias("cleaned_md5"))


def page_join_nonblank(spark, sf_dir):
    joined = cleaning.join_pages(F.split(F.col("text"), "\n"))
    return _noisy(spark, sf_dir).select("doc_id", F.length(joined).alias("n_chars"), _fingerprint(joined).alias("joined_md5"))


def recursive_windows(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").withColumn("chunks", recursive.windows(F.col("text")))
    return recursive.to_chunks(docs, "chunks", "doc_id", include_metadata=False)


def _chunked(spark, sf_dir, **options):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.withColumn("chunks", recursive.split(cleaning.clean_text(F.col("text")), **options))


def recursive_chunks(spark, sf_dir):
    return recursive.to_chunks(_chunked(spark, sf_dir), "chunks", "doc_id").select("doc_id", "chunk_id", "text", "num_characters", "metadata.*")


def recursive_chunks_characters(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("chunks", recursive.split(F.col("text"), separators=[""]))
    return recursive.to_chunks(docs, "chunks", "doc_id", include_metadata=False)


def recursive_chunk_stats(spark, sf_dir):
    found = incremental.chunk_statistics(recursive.to_chunks(_chunked(spark, sf_dir), "chunks", "doc_id"))
    return found.withColumn("avg_chars", F.round("avg_chars", 6))


def split_sentences(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return each(docs, sentences.split_sentences(F.col("text")), "doc_id", place="ord", value="sentence")


def sentence_stats(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").withColumn("sentences", sentences.split_sentences(F.col("text")))
    return sentences.sentence_stats(docs, "sentences").select("sentences", F.round("avg_length", 6).alias("avg_length"), "min_length", "max_length")


def embedding_norms(spark, sf_dir):
    found = embed.norm_statistics(_read(spark, sf_dir, "embeddings", "embedding"), "embedding")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


def embedding_normalize(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(F.col("embedding"), lambda x: x.cast("double") * 3).alias("v"))
    unit = vectors.l2_normalize(F.col("v"))
    return rows.select("vec_id", F.posexplode(unit).alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("x"))


def _clusters(spark, sf_dir, impl, **options):
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    docs = maxmin.gather(rows, "label", "vec_id", "vec_id", "embedding")
    found = maxmin.cluster(docs, "embedding", impl=impl, **options)
    own = each(found, maxmin.paragraphs(F.col("vec_id"), F.col("starts")), "label", place="chunk_id", value="members")
    return own.select("label", "chunk_id", F.explode("members").alias("vec_id"))


def maxmin_default(spark, sf_dir):
    return _clusters(spark, sf_dir, "arrow")


def maxmin_low_threshold(spark, sf_dir):
    return _clusters(spark, sf_dir, "arrow", fixed_threshold=LOW)


def maxmin_low_threshold_hof(spark, sf_dir):
    return _clusters(spark, sf_dir, "hof", fixed_threshold=LOW)


def maxmin_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").withColumn("sentences", sentences.split_sentences(F.col("text")))
    found = maxmin.embed_and_cluster(docs, "sentences")
    own = maxmin.to_chunks(found, "sentences", "starts", "doc_id")
    joined = _fingerprint(F.array_join("metadata.sentences", "\n")).alias("sentences_md5")
    return own.select("doc_id", "chunk_id", "text", "num_sentences", "metadata.source_file", "metadata.chunking_method", "metadata.num_characters", joined)


def maxmin_chunk_stats(spark, sf_dir):
    n = F.col("num_sentences")
    return maxmin_documents(spark, sf_dir).agg(F.count(n).alias("chunks"), F.round(F.avg(n), 6).alias("avg_sentences"), F.min(n).alias("min_sentences"), F.max(n).alias("max_sentences"))


def _partitioned(spark, sf_dir):
    return elements.partition(_read(spark, sf_dir, "pages", "page_id", "url", "html"), "html", "url")


def html_elements(spark, sf_dir):
    return _partitioned(spark, sf_dir).select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")


def element_chunks(spark, sf_dir):
    return elements.to_chunks(_partitioned(spark, sf_dir), "page_id").select("page_id", "chunk_id", "text", "metadata.*")


def element_text_list(spark, sf_dir):
    texts = F.coalesce(elements.to_text_list(F.col("elements")), F.array().cast("array<string>"))
    return _partitioned(spark, sf_dir).select("page_id", F.size(texts).alias("texts"), _fingerprint(F.array_join(texts, "\n")).alias("texts_md5"))


def element_histogram(spark, sf_dir):
    return elements.histogram(_partitioned(spark, sf_dir))


def element_size_stats(spark, sf_dir):
    found = elements.size_stats(elements.to_chunks(_partitioned(spark, sf_dir), "page_id"))
    return found.withColumn("avg_chars", F.round("avg_chars", 6))


def skip_existing(spark, sf_dir):
    return incremental.skip_existing(_read(spark, sf_dir, "documents", "doc_id", "source"), _read(spark, sf_dir, "labels", "doc_id"), "doc_id")


def already_done(spark, sf_dir):
    return incremental.already_done(_read(spark, sf_dir, "documents", "doc_id", "source"), _read(spark, sf_dir, "labels", "doc_id"), "doc_id")


def run_statistics(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    done = _read(spark, sf_dir, "labels", "doc_id").distinct().withColumn("done", F.lit(True))
    marked = docs.join(done, "doc_id", "left").withColumn("chunks", F.size(recursive.windows(F.col("text"))))
    found = marked.select("doc_id", "chunks", incremental.outcome(F.col("done"), F.col("text")).alias("outcome"))
    stats = incremental.run_statistics(found, "outcome", F.col("chunks"))
    return stats.withColumn("avg_chunks", F.round("avg_chunks", 6))


def _windowed(spark, sf_dir):
    return _read(spark, sf_dir, "documents", "doc_id", "text").withColumn("chunks", recursive.windows(F.col("text")))


def chunk_json(spark, sf_dir):
    return arrays_json(_chunked(spark, sf_dir), "doc_id", recursive.structs(F.col("chunks"), F.col("doc_id")))


def chunk_json_windows(spark, sf_dir):
    return arrays_json(_windowed(spark, sf_dir), "doc_id", recursive.structs(F.col("chunks"), F.col("doc_id"), include_metadata=False))


def chunk_json_compact(spark, sf_dir):
    slim = F.transform("chunks", lambda text, k: F.struct(k.alias("chunk_id"), F.length(text).alias("num_characters")))
    return arrays_json(_windowed(spark, sf_dir), "doc_id", slim, pretty=False)


def _query(spark, sf_dir) -> list[float]:
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding").where(F.col("vec_id") == VECTOR)
    return list(rows.first()["embedding"])


def topk_similarity(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    found = retrieval.top_k(chunks, "embedding", _query(spark, sf_dir), "vec_id", TOP)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def topk_batch(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = retrieval.search(chunks, "embedding", "vec_id", chunks.where(F.col("vec_id") % 20 == 0), "embedding", "vec_id", 5)
    return found.select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


def topk_filtered(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    found = retrieval.top_k(chunks, "embedding", _query(spark, sf_dir), "vec_id", 4, {"label": 3})
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def similarity_threshold(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = retrieval.above(chunks, "embedding", _query(spark, sf_dir), FLOOR)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def dot_top3(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    score = vectors.dot(F.col("embedding"), retrieval.as_vector(_query(spark, sf_dir)))
    return chunks.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(3)


def mmr(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return retrieval.mmr(chunks, "embedding", _query(spark, sf_dir), "vec_id").select("vec_id", "rank")


def mrl_truncate(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cut = vectors.truncate(F.col("embedding"), DIMENSIONS)
    return rows.select("vec_id", F.posexplode(cut).alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("x"))


def collection_upsert(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "source")
    changes = _read(spark, sf_dir, "labels", "doc_id").distinct().withColumn("source", F.lit("changed"))
    return retrieval.upsert(docs, changes, "doc_id")


def collection_delete(spark, sf_dir):
    return retrieval.delete(_read(spark, sf_dir, "documents", "doc_id", "source"), _read(spark, sf_dir, "labels", "doc_id"), "doc_id")


def instruct_queries(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", chat.instruct("Find the passage", F.col("text")).alias("query"))


def _turns(spark, sf_dir):
    """Conversations in which every fourth turn thinks first and some turns switch thinking."""
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    thought = F.when(F.pmod("conv_id", F.lit(4)) == 0, F.concat(F.lit("<think>\nhm </think> so\n</think>\n\n"), "text")).otherwise(F.col("text"))
    switch = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 0, F.concat("text", F.lit(" /no_think"))).when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 0, F.concat("text", F.lit(" /think"))).otherwise(F.col("text"))
    return turns.withColumn("text", F.when(F.col("role") == "assistant", thought).otherwise(switch))


def thinking_split(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.length(chat.thinking(F.col("text"))).alias("n_thinking"), _fingerprint(chat.content(F.col("text"))).alias("content_md5"))


def conversation_history(spark, sf_dir):
    return chat.history(_turns(spark, sf_dir)).select("conv_id", F.size("messages").alias("turns"), _fingerprint(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")).alias("history_md5"))


def think_switch(spark, sf_dir):
    return chat.think_switch(_turns(spark, sf_dir)).select("conv_id", "turn", "thinking")


_ALL = [
    clean_documents, clean_plain_documents, clean_reduction_stats, clean_advanced_numbers, clean_advanced_punct, remove_headers, page_join_nonblank,
    recursive_windows, recursive_chunks, recursive_chunks_characters, recursive_chunk_stats, split_sentences, sentence_stats,
    embedding_norms, embedding_normalize, maxmin_default, maxmin_low_threshold, maxmin_low_threshold_hof, maxmin_documents, maxmin_chunk_stats,
    html_elements, element_chunks, element_text_list, element_histogram, element_size_stats,
    skip_existing, already_done, run_statistics, chunk_json, chunk_json_windows, chunk_json_compact,
    topk_similarity, topk_batch, topk_filtered, similarity_threshold, dot_top3, mmr, mrl_truncate, collection_upsert, collection_delete,
    instruct_queries, thinking_split, conversation_history, think_switch,
]
QUERIES = {f.__name__: f for f in _ALL}


def _literal(text: str) -> str:
    """A text as SQL; what isn't printable ASCII by its code."""
    parts, plain = [], ""
    for c in text:
        if 32 <= ord(c) < 127:
            plain += c.replace("'", "''")
        else:
            parts += ["'" + plain + "'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
    return "(" + " || ".join(parts + ["'" + plain + "'"] * (bool(plain) or not parts)) + ")"


def _rewritten(text: str, rewrites: list[tuple[str, str]]) -> str:
    for pattern, to in rewrites:
        text = f"regexp_replace({text}, {_literal(pattern)}, {_literal(to)}, 'g')"
    return text


def _stripped(text: str) -> str:
    return _rewritten(text, [(f"^{S}+|{S}+$", "")])


def _cleaned(text: str) -> str:
    rewrites = []
    for name, pattern, to in cleaning.REWRITES:
        if name == "broken line":  # RE2 has no look-around; what one pass consumes as context hides the next match
            rewrites += [("([a-z,;])\n([a-z])", "\\1 \\2")] * 2
        else:
            rewrites.append((re2(pattern), to))
    return _stripped(_rewritten(text, rewrites))


_NOISED = "(SELECT doc_id, coalesce(text, '') || " + " || ".join(f"CASE WHEN doc_id % {k} = {r} THEN {_literal(chr(10) + x)} ELSE '' END" for k, r, x in NOISE) + " AS text FROM documents)"
_SHORTER = [(" {2,}", " "), ("\n{3,}", "\n\n")]
_HEADERS = _stripped(_rewritten("text", [*(("(?im)" + p.replace("{s}", S), "") for p in cleaning.HEADERS), ("\n{3,}", "\n\n")]))
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, {_literal(f'([.!?]){S}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda s: {_stripped('s')}), lambda s: length(s) > 0)"
_WINDOWS = f"list_filter(list_transform(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) END), lambda k: {_stripped('substr(text, k * 800 + 1, 1000)')}), lambda c: length(c) > 0)"
_D = "CAST(embedding AS DOUBLE[])"
_Q = f"(SELECT {_D} FROM embeddings WHERE vec_id = {VECTOR})"
_COSINE = f"list_cosine_similarity({_D}, {_Q})"
_WINDOW_ROWS = f"SELECT doc_id, CAST(unnest(range(0, len(c))) AS INTEGER) AS chunk_id, unnest(c) AS text FROM (SELECT doc_id, {_WINDOWS} AS c FROM documents)"


def _maxmin(threshold: float, rows: str = "embeddings") -> str:
    """Clusters of ``rows`` (label, vec_id, embedding)."""
    return f"""
        WITH RECURSIVE v AS MATERIALIZED (SELECT label, vec_id, {_D} AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM {rows}),
        s AS MATERIALIZED (SELECT a.label, a.i, list(list_cosine_similarity(a.e, b.e) ORDER BY b.i) AS near FROM v a JOIN v b ON a.label = b.label AND b.i < a.i GROUP BY a.label, a.i),
        f AS (
            SELECT label, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start, CAST(NULL AS DOUBLE) AS lowest, 0 AS chunk_id FROM v WHERE i = 0
            UNION ALL
            SELECT label, i, CASE WHEN joins THEN start ELSE i END, CASE WHEN joins THEN low END, CASE WHEN joins THEN chunk_id ELSE chunk_id + 1 END
            FROM (SELECT label, i, start, chunk_id, CASE WHEN m = 1 THEN near[1] ELSE least(list_min(near), lowest) END AS low,
                         CASE WHEN m = 1 THEN 1.5 * near[1] ELSE list_max(near) END
                         > greatest(CASE WHEN m = 1 THEN 0.0 ELSE lowest * 0.9 / (1 + exp(CAST(1 - m AS DOUBLE))) END, {threshold}) AS joins
                  FROM (SELECT f.label, s.i, f.start, f.chunk_id, f.lowest, s.i - f.start AS m, s.near[f.start + 1:s.i] AS near
                        FROM f JOIN s ON f.label = s.label AND s.i = f.i + 1)))
        SELECT v.label, f.chunk_id, v.vec_id FROM f JOIN v ON f.label = v.label AND f.i = v.i"""


#: Sentences of documents with the vectors that ``embed.HashEmbedder`` gives them; hashes are CRC-32, byte by byte.
_EMBEDDED = f"""(
    WITH b AS (SELECT list(CAST(c AS BIGINT) ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
    s AS MATERIALIZED (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
    w AS MATERIALIZED (SELECT doc_id, i, word, count(*) AS times FROM (SELECT doc_id, i, unnest(string_split_regex(lower(sentence), {_literal(f'{S}+')})) AS word FROM s) WHERE word <> '' GROUP BY doc_id, i, word),
    p AS (SELECT word, unnest(list_prepend('<' || word || '>', list_transform(range(1, length(word) + 1), lambda j: substr('<' || word || '>', j, 3)))) AS part FROM (SELECT DISTINCT word FROM w)),
    h AS (SELECT part, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(part))), lambda j: CAST('0x' || substr(hex(encode(part)), 2 * j + 1, 2) AS BIGINT))),
                                       lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM (SELECT DISTINCT part FROM p), b),
    d AS (SELECT word, (h >> 1) % 64 AS place, sum(1 - 2 * (h & 1)) AS x FROM p JOIN h USING (part) GROUP BY word, place),
    e AS (SELECT doc_id, i, place, sum(times * x) AS x FROM w JOIN d USING (word) GROUP BY doc_id, i, place),
    v AS (SELECT doc_id, i, list(coalesce(CAST(x AS DOUBLE), 0) ORDER BY place) AS v, sqrt(sum(coalesce(CAST(x * x AS DOUBLE), 0))) AS size FROM (SELECT doc_id, i, unnest(range(64)) AS place FROM s) LEFT JOIN e USING (doc_id, i, place) GROUP BY doc_id, i)
    SELECT doc_id AS label, i AS vec_id, list_transform(v, lambda x: CAST(x / CASE WHEN size = 0 THEN 1 ELSE size END AS FLOAT)) AS embedding FROM v)"""
_PARAGRAPHS = f"""(
    SELECT label AS doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, string_agg(sentence, ' ' ORDER BY i) AS text, CAST(count(*) AS INTEGER) AS num_sentences, md5(string_agg(sentence, chr(10) ORDER BY i)) AS sentences_md5
    FROM ({_maxmin(0.6, _EMBEDDED)}) JOIN (SELECT doc_id AS label, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)) USING (label)
    WHERE vec_id = i GROUP BY label, chunk_id)"""


def _split(docs: str, size: int = 1000, overlap: int = 200) -> str:
    """Rows of chunks (doc_id, chunk_id, text) of ``docs`` (doc_id, text) by the four separators.

    Each level cuts texts at the first separator that they have; pieces of ``size`` go on to the next level, and runs of
    shorter ones are merged: from each piece on, where a chunk would end and the next one begin is looked up in running
    sizes, and chunks follow these from the run's first piece.
    """
    levels = []
    for k in range(4):
        texts = f"SELECT doc_id, [] :: BIGINT[] AS k, text, 1 AS finer FROM {docs}" if k == 0 else f"SELECT doc_id, list_append(k, i) AS k, piece AS text, level + 1 AS finer FROM p{k - 1} WHERE length(piece) >= {size} AND level < 4"
        levels.append(f"""
        t{k} AS (SELECT doc_id, k, text, CASE WHEN finer <= 1 AND contains(text, chr(10) || chr(10)) THEN 1 WHEN finer <= 2 AND contains(text, chr(10)) THEN 2 WHEN finer <= 3 AND contains(text, ' ') THEN 3 ELSE 4 END AS level FROM ({texts})),
        c{k} AS (SELECT doc_id, k, level, CASE level WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) WHEN 3 THEN ' ' ELSE '' END AS sep,
                        CASE WHEN level = 4 THEN list_transform(range(1, length(text) + 1), lambda j: substr(text, j, 1)) ELSE string_split(text, CASE level WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) ELSE ' ' END) END AS parts FROM t{k}),
        p{k} AS (SELECT doc_id, k, level, i, piece FROM (SELECT doc_id, k, level, i, CASE WHEN i = 1 THEN part ELSE sep || part END AS piece
                 FROM (SELECT doc_id, k, level, sep, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM c{k})) WHERE length(piece) > 0),
        r{k} AS (SELECT doc_id, list_append(k, min(i) OVER (PARTITION BY doc_id, k, large)) AS k, i, piece FROM (
                 SELECT doc_id, k, i, piece, count(*) FILTER (length(piece) >= {size} AND level < 4) OVER (PARTITION BY doc_id, k ORDER BY i) AS large, level FROM p{k}) WHERE length(piece) < {size} OR level = 4)""")
    return f"""
        WITH RECURSIVE {','.join(levels)},
        pieces AS MATERIALIZED (SELECT doc_id, k, i, piece, length(piece) AS z, sum(length(piece)) OVER (PARTITION BY doc_id, k ORDER BY i) AS upto
                                FROM ({' UNION ALL '.join(f'SELECT * FROM r{k}' for k in range(4))})),
        runs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, k) AS run, doc_id, k, string_agg(piece, '' ORDER BY i) AS text, sum(z) AS total FROM pieces GROUP BY doc_id, k),
        x AS MATERIALIZED (SELECT run, upto - z AS a, z FROM pieces JOIN runs USING (doc_id, k) UNION ALL SELECT run, total AS a, 0 AS z FROM runs),
        ends AS (SELECT s.run, s.a, e.a AS b, e.a - least({overlap}, {size} - e.z) AS since FROM x s ASOF JOIN x e ON s.run = e.run AND s.a + {size} >= e.a),
        steps AS MATERIALIZED (SELECT ends.run, ends.a, ends.b, n.a AS after FROM ends ASOF JOIN x n ON ends.run = n.run AND ends.since <= n.a),
        w AS (SELECT run, 0 AS w, a, b, after FROM steps WHERE a = 0
              UNION ALL SELECT w.run, w.w + 1, n.a, n.b, n.after FROM w JOIN steps n ON w.run = n.run AND w.after = n.a JOIN runs ON runs.run = w.run WHERE w.b < runs.total),
        cut AS (SELECT doc_id, k, w, {_stripped('substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))')} AS text FROM w JOIN runs USING (run))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, w) - 1 AS INTEGER) AS chunk_id, text FROM cut WHERE length(text) > 0"""


_CHUNK_ROWS = _split(f"(SELECT doc_id, {_cleaned('coalesce(text, ' + chr(39) * 2 + ')')} AS text FROM documents)")
_TURNS = """(SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 4 = 0 THEN '<think>' || chr(10) || 'hm </think> so' || chr(10) || '</think>' || chr(10) || chr(10) || text ELSE text END
    ELSE CASE WHEN (conv_id + turn) % 5 = 0 THEN text || ' /no_think' WHEN (conv_id + turn) % 7 = 0 THEN text || ' /think' ELSE text END END AS text FROM conversations)"""
_LAST = "string_split(text, '</think>')"
_CONTENT = _stripped(f"{_LAST}[-1]")
_THOUGHT = "CASE WHEN contains(text, '</think>') THEN " + _stripped("regexp_replace(substr(text, 1, length(text) - length(" + _LAST + "[-1]) - 8), '^\\s*<think>', '')") + " ELSE '' END"

_BLOCKS = "p|li|ul|nav|div|article|h1|footer|body|br"
_MARKED = _rewritten("html", [("(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", ""), ("(?s)<!.*?>", ""), (f"<(/?({_BLOCKS}))( [^>]*)?>", "\x01\\1\x02"), ("<[^>]*>", "")])
_NAMED = _rewritten("split_part(s, chr(2), 2)", [("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;?", "&"), (f"{S}+", " ")])
#: Elements of pages made of these blocks without tables or nested lists; their type is that of the last tag but ``br``.
_ELEMENTS = f"""(
    SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, element_type, text
    FROM (SELECT page_id, url, i, text, CASE last_value(nullif(tag, 'br') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)
                 WHEN 'p' THEN 'NarrativeText' WHEN 'li' THEN 'ListItem' WHEN 'h1' THEN 'Title' WHEN 'footer' THEN 'Footer' ELSE 'UncategorizedText' END AS element_type
          FROM (SELECT page_id, url, i, split_part(s, chr(2), 1) AS tag, {_stripped(_NAMED)} AS text
                FROM (SELECT page_id, url, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM (SELECT page_id, url, string_split({_MARKED}, chr(1)) AS parts FROM pages))))
    WHERE length(text) > 0)"""
_ELEMENT_ID = "substr(sha256(coalesce(url, 'None') || chr(10) || ord || chr(10) || text), 1, 32)"
_ELEMENT_REST = f"element_type, {_ELEMENT_ID} AS element_id, text, CAST(NULL AS INTEGER) AS page_number, CAST(NULL AS VARCHAR) AS coordinates, url AS filename, CAST(NULL AS VARCHAR) AS text_as_html"

ORACLES = {
    "html_elements": f"SELECT page_id, ord, {_ELEMENT_REST} FROM {_ELEMENTS}",
    "element_chunks": f"SELECT page_id, ord AS chunk_id, {_ELEMENT_REST} FROM {_ELEMENTS}",
    "element_text_list": f"SELECT page_id, CAST(count(text) AS INTEGER) AS texts, md5(coalesce(string_agg(text, chr(10) ORDER BY ord), '')) AS texts_md5 FROM pages LEFT JOIN {_ELEMENTS} USING (page_id) GROUP BY page_id",
    "element_histogram": f"SELECT element_type, count(*) AS n FROM {_ELEMENTS} GROUP BY element_type",
    "element_size_stats": f"SELECT CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 6) AS avg_chars FROM {_ELEMENTS}",
    "recursive_chunks": f"""
        SELECT doc_id, chunk_id, text, CAST(length(text) AS INTEGER) AS num_characters, CAST(doc_id AS VARCHAR) AS source_file, '{recursive.METHOD}' AS chunking_method, CAST(length(text) AS INTEGER) AS chunk_length FROM ({_CHUNK_ROWS})""",
    "recursive_chunk_stats": f"SELECT count(*) AS chunks, round(avg(length(text)), 6) AS avg_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars FROM ({_CHUNK_ROWS})",
    "chunk_json": f"""
        SELECT doc_id, '[ ' || string_agg('{{' || chr(10) || '  "chunk_id" : ' || chunk_id || ',' || chr(10) || '  "text" : ' || to_json(text) || ',' || chr(10) || '  "num_characters" : ' || length(text) || ',' || chr(10)
               || '  "metadata" : {{' || chr(10) || '    "source_file" : "' || doc_id || '",' || chr(10) || '    "chunking_method" : "{recursive.METHOD}",' || chr(10) || '    "chunk_length" : ' || length(text) || chr(10) || '  }}' || chr(10) || '}}', ', ' ORDER BY chunk_id) || ' ]' AS json
        FROM ({_CHUNK_ROWS}) GROUP BY doc_id""",
    "chunk_json_windows": f"""
        SELECT doc_id, '[ ' || string_agg('{{' || chr(10) || '  "chunk_id" : ' || chunk_id || ',' || chr(10) || '  "text" : ' || to_json(text) || ',' || chr(10) || '  "num_characters" : ' || length(text) || chr(10) || '}}', ', ' ORDER BY chunk_id) || ' ]' AS json
        FROM ({_WINDOW_ROWS}) GROUP BY doc_id""",
    "clean_documents": f"SELECT doc_id, CAST(length(text) AS INTEGER) AS n_before, CAST(length(cleaned) AS INTEGER) AS n_after, cleaned FROM (SELECT doc_id, text, {_cleaned('text')} AS cleaned FROM {_NOISED})",
    "clean_plain_documents": f"SELECT doc_id, {_cleaned(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS cleaned FROM documents",
    "clean_reduction_stats": f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(cleaned)) / CAST(length(text) AS DOUBLE) * 100 END, 6) AS reduction_percent FROM (SELECT doc_id, text, {_cleaned('text')} AS cleaned FROM {_NOISED})",
    "clean_advanced_numbers": f"SELECT doc_id, md5({_stripped(_rewritten(_cleaned('text'), [(f'{DIGIT}+', ''), *_SHORTER]))}) AS cleaned_md5 FROM {_NOISED}",
    "clean_advanced_punct": f"SELECT doc_id, md5({_stripped(_rewritten(_cleaned('text'), [('[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_' + S[1:], ''), *_SHORTER]))}) AS cleaned_md5 FROM {_NOISED}",
    "remove_headers": f"SELECT doc_id, md5({_HEADERS}) AS cleaned_md5 FROM {_NOISED}",
    "page_join_nonblank": f"SELECT doc_id, CAST(length(j) AS INTEGER) AS n_chars, md5(j) AS joined_md5 FROM (SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda p: length({_stripped('p')}) > 0), chr(10)), '') AS j FROM {_NOISED})",
    "recursive_windows": f"SELECT doc_id, chunk_id, text, CAST(length(text) AS INTEGER) AS num_characters FROM ({_WINDOW_ROWS})",
    "recursive_chunks_characters": f"SELECT doc_id, chunk_id, text, CAST(length(text) AS INTEGER) AS num_characters FROM ({_WINDOW_ROWS})",
    "split_sentences": f"SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS ord, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)",
    "sentence_stats": f"SELECT count(n) AS sentences, round(coalesce(avg(n), 0), 6) AS avg_length, CAST(coalesce(min(n), 0) AS DOUBLE) AS min_length, CAST(coalesce(max(n), 0) AS DOUBLE) AS max_length FROM (SELECT length(unnest({_SENTENCES})) AS n FROM documents)",
    "embedding_norms": f"SELECT round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS avg_norm FROM (SELECT sqrt(list_inner_product({_D}, {_D})) AS n FROM embeddings)",
    "embedding_normalize": f"SELECT vec_id, CAST(unnest(range(0, len(e))) AS INTEGER) AS place, round(unnest(e) / sqrt(list_inner_product(e, e)), 6) AS x FROM (SELECT vec_id, {_D} AS e FROM embeddings)",
    "maxmin_default": _maxmin(0.6),
    "maxmin_documents": f"SELECT doc_id, chunk_id, text, num_sentences, CAST(doc_id AS VARCHAR) AS source_file, '{maxmin.METHOD}' AS chunking_method, CAST(length(text) AS INTEGER) AS num_characters, sentences_md5 FROM {_PARAGRAPHS}",
    "maxmin_chunk_stats": f"SELECT count(*) AS chunks, round(avg(num_sentences), 6) AS avg_sentences, min(num_sentences) AS min_sentences, max(num_sentences) AS max_sentences FROM {_PARAGRAPHS}",
    "maxmin_low_threshold": _maxmin(LOW),
    "maxmin_low_threshold_hof": _maxmin(LOW),
    "skip_existing": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "already_done": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "run_statistics": f"""
        SELECT count(*) AS total_files, count(*) FILTER (o = 'processed') AS processed, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed,
               CAST(sum(n) FILTER (o = 'processed') AS BIGINT) AS total_chunks, round(sum(n) FILTER (o = 'processed') / CAST(count(*) FILTER (o = 'processed') AS DOUBLE), 6) AS avg_chunks
        FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' WHEN coalesce(length(text), 0) = 0 THEN 'failed' ELSE 'processed' END AS o, len({_WINDOWS}) AS n FROM documents)""",
    "chunk_json_compact": f"""SELECT doc_id, '[' || string_agg('{{"chunk_id":' || chunk_id || ',"num_characters":' || length(text) || '}}', ',' ORDER BY chunk_id) || ']' AS json FROM ({_WINDOW_ROWS}) GROUP BY doc_id""",
    "topk_similarity": f"SELECT vec_id, label, round(1 - {_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT {TOP}",
    "topk_batch": f"""
        SELECT query, CAST(n - 1 AS INTEGER) AS rank, vec_id, round(1 - s, 6) AS score
        FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(q.e, e.e) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, e.e) DESC, e.vec_id) AS n
              FROM (SELECT vec_id, {_D} AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, {_D} AS e FROM embeddings) e) WHERE n <= 5""",
    "mmr": f"""
        WITH RECURSIVE c AS (SELECT vec_id, {_D} AS e, {_COSINE} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM c a, c b),
        r AS (
            SELECT 0 AS rank, [(SELECT vec_id FROM c ORDER BY s DESC, vec_id LIMIT 1)] AS chosen
            UNION ALL
            SELECT rank + 1, list_append(chosen, (SELECT c.vec_id FROM c WHERE NOT list_contains(chosen, c.vec_id)
                ORDER BY round(0.5 * c.s - 0.5 * (SELECT max(p.s) FROM p WHERE p.a = c.vec_id AND list_contains(chosen, p.b)), 12) DESC, c.s DESC, c.vec_id LIMIT 1))
            FROM r WHERE rank < 3)
        SELECT vec_id, CAST(n - 1 AS INTEGER) AS rank FROM (SELECT unnest(chosen) AS vec_id, unnest(range(1, 5)) AS n FROM r WHERE rank = 3)""",
    "topk_filtered": f"SELECT vec_id, label, round(1 - {_COSINE}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COSINE} DESC, vec_id LIMIT 4",
    "similarity_threshold": f"SELECT vec_id, round({_COSINE}, 6) AS similarity FROM embeddings WHERE {_COSINE} >= {FLOOR}",
    "dot_top3": f"SELECT vec_id, round(list_inner_product({_D}, {_Q}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 3",
    "mrl_truncate": f"SELECT vec_id, CAST(unnest(range(0, len(e))) AS INTEGER) AS place, round(unnest(e) / sqrt(list_inner_product(e, e)), 6) AS x FROM (SELECT vec_id, ({_D})[1:{DIMENSIONS}] AS e FROM embeddings)",
    "collection_upsert": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT DISTINCT doc_id, 'changed' AS source FROM labels",
    "collection_delete": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "instruct_queries": "SELECT item_id, 'Instruct: Find the passage' || chr(10) || 'Query: ' || text AS query FROM benchmark",
    "thinking_split": f"SELECT conv_id, turn, CAST(length({_THOUGHT}) AS INTEGER) AS n_thinking, md5({_CONTENT}) AS content_md5 FROM {_TURNS}",
    "conversation_history": f"SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, md5(string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN {_CONTENT} ELSE text END, chr(10) ORDER BY turn)) AS history_md5 FROM {_TURNS} GROUP BY conv_id",
    "think_switch": f"""
        SELECT conv_id, turn, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), true) AS thinking
        FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE regexp_extract(text, '(?s).*(/no_think|/think)\\b', 1) WHEN '/think' THEN true WHEN '/no_think' THEN false END END AS s FROM {_TURNS})""",
}
