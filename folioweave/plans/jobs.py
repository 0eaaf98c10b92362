"""Batch jobs from a directory to a table. Each does only what isn't done, and returns one row of statistics.

A bad document never stops a job: it is counted as failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from folioweave.functions.cleaning import clean_text, stem, strip
from folioweave.operators import elements, embed, maxmin, punkt, recursive
from folioweave.operators.cache import Cache, embed_cached
from folioweave.operators.incremental import outcome, run_statistics
from folioweave.operators.sentences import split_sentences
from folioweave.plans.logs import job_log
from folioweave.sources import listing
from folioweave.sources.files import Extractor, extract_text, names, read_some, read_texts, texts_of
from folioweave.sources.sinks import chunk_files, properties_text, text_files, write_files


#: Documents that a log names, failed ones and others.
NAMED = 100


def _fs(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def _recover(spark: SparkSession, output: str) -> None:
    """Puts a table back that a run moved aside and was ended before it had put the new one in its place."""
    (old, fs), (at, _) = _fs(spark, f"{output}.old"), _fs(spark, output)
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)


def _put(spark: SparkSession, rows: DataFrame, output: str, skip_existing: bool, only: str | None) -> None:
    """Appends what was new; else replaces the table, or of it the one document ``only``.

    For that, the whole new table is written beside the old one, which is moved aside and deleted last, so that at any
    moment one of them is whole.
    """
    if only is None or not _exists(spark, output):
        rows.write.mode("append" if skip_existing else "overwrite").parquet(output)
        return
    others = spark.read.parquet(output).where(F.col("source_file") != only)
    others.unionByName(rows, allowMissingColumns=True).write.mode("overwrite").parquet(f"{output}.new")
    (at, fs), (new, _), (old, _) = (_fs(spark, output + end) for end in ("", ".new", ".old"))
    fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def output_files(spark: SparkSession, output: str) -> DataFrame:
    """The sources that a job's table has: a table, as there may be any number."""
    return spark.read.parquet(output).select("source_file").distinct()


def failures(spark: SparkSession, output: str) -> DataFrame:
    """``source_file``, ``error`` and ``at`` of what failed in a job's runs."""
    path = f"{output}-failed"
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], "source_file string, error string, at timestamp")


def document_sizes(spark: SparkSession, output: str) -> DataFrame:
    """For each document that a job's runs did: ``source_file``, ``at``, its ``characters``, those ``written`` (or null) and its ``chunks`` (or null)."""
    return spark.read.schema("source_file string, at timestamp, characters long, written long, chunks int").parquet(f"{output}-sizes")


def reduced(before: int | None, after: int | None) -> float:
    """By how many percent a text got shorter."""
    return 100 * (1 - (after or 0) / before) if before else 0.0


def _run(
    spark: SparkSession, job: str, input: str, pattern: str, read: Callable[[DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame], rows: Callable[[DataFrame], DataFrame],
    output: str, skip_existing: bool, size: str | None, only: str | None, log_dir: str | None, files_to: str | None,
) -> DataFrame:
    """``read`` turns files into documents, ``make`` adds what a document becomes, null or empty if it failed; ``rows`` are written.

    Files that the table in ``output`` has are told by their names and not read. With ``only``, the name of one file, no
    other is looked at, and it is done whether it was done before or not. Reasons for failed documents are appended to
    the table ``failures``, sizes of the others to ``document_sizes``, and the log names some (NAMED of each). With ``files_to``, a folder that executors share, each document's
    result is also written as a file of its own. Statistics: total_files, processed, skipped, failed, total_chunks,
    avg_chunks and duration (seconds).
    """
    began = time.time()
    _recover(spark, output)
    distributed = listing.readable(input)
    listed = (listing.listed(spark, input, pattern) if distributed else names(spark, input, pattern)).persist(StorageLevel.MEMORY_AND_DISK)
    if only is not None:
        listed, skip_existing = listed.where(F.col("source_file") == only), False
    done = output_files(spark, output) if skip_existing and _exists(spark, output) else spark.createDataFrame([], "source_file string")
    new = listed.join(done, "source_file", "left_anti")
    with job_log(job, log_dir) as log:
        log.info("started: %s to %s", input, output)
        read_files = listing.contents(new).withColumnRenamed("error", "read_error") if distributed else read_some(spark, input, pattern, new)
        made = make(read(read_files)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fine = F.coalesce(F.size(size) > 0, F.lit(False)) if size else F.coalesce(F.length("text") > 0, F.lit(False))
            # the count fills the cache before the table that ``done`` reads is changed
            results = made.select("source_file", outcome(F.lit(False), F.when(fine, "x")).alias("outcome"), (F.size(size) if size else F.lit(None).cast("int")).alias("n"))
            skipped = listed.join(done, "source_file", "left_semi").select("source_file", F.lit("skipped").alias("outcome"), F.lit(None).cast("int").alias("n"))
            stats = run_statistics(results.unionByName(skipped), "outcome", F.col("n"))
            found = stats.first()
            _put(spark, rows(made.where(fine)), output, skip_existing, only)
            if files_to is not None:
                own = rows(made.where(fine))
                log.info("files written to %s: %d", files_to, write_files(text_files(own) if size is None else chunk_files(own), files_to))
            sizes = made.where(fine).select(
                "source_file", F.lit(datetime.fromtimestamp(began)).alias("at"), (F.col("n_before") if "n_before" in made.columns else F.length("text") if "text" in made.columns else F.lit(None)).cast("long").alias("characters"),
                (F.length("text") if size is None else F.lit(None)).cast("long").alias("written"), (F.size(size) if size else F.lit(None)).cast("int").alias("chunks"),
            )
            sizes.write.mode("append").parquet(f"{output}-sizes")
            for r in sizes.orderBy("source_file").limit(NAMED).collect():
                log.info("%s: %s characters, %s", r["source_file"], r["characters"], f"{r['chunks']} chunks" if size else f"{r['written']} left ({reduced(r['characters'], r['written']):.2f} % less)")
            if found["failed"]:
                error = F.coalesce(*(F.col(c) for c in ("read_error", "error") if c in made.columns), F.lit("no text" if size is None else "no chunks"))
                failed = made.where(~fine).select("source_file", error.alias("error"), F.lit(datetime.fromtimestamp(began)).alias("at"))
                failed.write.mode("append").parquet(f"{output}-failed")
                for r in failed.limit(NAMED).collect():
                    log.error("failed: %s: %s", r["source_file"], r["error"])
            log.info("finished: %d files, %d processed, %d skipped, %d failed", found["total_files"], found["processed"], found["skipped"], found["failed"])
            return spark.createDataFrame([(*found, time.time() - began)], stats.schema.add("duration", "double"))
        finally:
            made.unpersist()
            listed.unpersist()


def preprocess(spark: SparkSession, input: str, output: str, *, extractor: Extractor, save_metadata: bool = False, skip_existing: bool = True, pattern: str = "*.pdf", only: str | None = None, log_dir: str | None = None, files_to: str | None = None) -> DataFrame:
    """Files to cleaned texts: source_file, stem, text and, if asked for, the properties as lines in ``metadata_text``."""

    def make(files: DataFrame) -> DataFrame:
        found = extract_text(files, extractor)
        return found.withColumn("n_before", F.length("text")).withColumn("text", F.when(F.length("text") > 0, clean_text(F.col("text"))))

    def rows(docs: DataFrame) -> DataFrame:
        more = [properties_text(F.col("properties")).alias("metadata_text")] if save_metadata else []
        return docs.select("source_file", stem(F.col("source_file")).alias("stem"), "text", *more)

    return _run(spark, "preprocess", input, pattern, lambda f: f, make, rows, output, skip_existing, None, only, log_dir, files_to)


def chunk_recursive(spark: SparkSession, input: str, output: str, *, chunk_size: int = 1000, chunk_overlap: int = 200, separators: Sequence[str] | None = None, include_metadata: bool = True, skip_existing: bool = True, only: str | None = None, log_dir: str | None = None, files_to: str | None = None) -> DataFrame:
    """Text files to size-bounded chunks."""

    def make(docs: DataFrame) -> DataFrame:
        chunks = recursive.split(F.when(F.length(strip(F.col("text"))) > 0, F.col("text")), chunk_size=chunk_size, chunk_overlap=chunk_overlap, separators=separators)
        return docs.withColumn("chunks", chunks)

    return _run(spark, "recursive", input, "*.txt", texts_of, make, lambda d: recursive.to_chunks(d, "chunks", "source_file", include_metadata), output, skip_existing, "chunks", only, log_dir, files_to)


def chunk_maxmin(spark: SparkSession, input: str, output: str, *, embedder: embed.Loader | None = None, fixed_threshold: float = 0.6, c: float = 0.9, init_constant: float = 1.5, include_metadata: bool = True, skip_existing: bool = True, batch_size: int = 8, sentences: str = "learnt", learn_from: str | None = None, cache: Cache | None = None, only: str | None = None, log_dir: str | None = None, files_to: str | None = None) -> DataFrame:
    """Text files to chunks of sentences that belong together.

    ``sentences``: ``learnt`` from the texts in ``learn_from``, or else from those that are done; or ``pattern``, by which every
    full stop before white space ends one. With a ``cache``, ``embedder`` embeds what that doesn't have.
    """
    models: list[punkt.Model] = []
    held: list[DataFrame] = []

    def make(docs: DataFrame) -> DataFrame:
        if sentences == "learnt":
            # files are read once, for learning and for cutting
            docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(docs)
            models.append(punkt.learn(read_texts(spark, learn_from, exclude_metadata=True) if learn_from else docs))
            cut = punkt.split(docs, models[0])
        else:
            cut = docs.withColumn("sentences", split_sentences(F.col("text")))
        if cache is not None:
            found = embed_cached(cut, "sentences", "embeddings", cache=cache, embedder=embedder or embed.HashEmbedder(), batch_size=batch_size)
            return maxmin.cluster(found, "embeddings", fixed_threshold=fixed_threshold, c=c, init_constant=init_constant).drop("embeddings")
        return maxmin.embed_and_cluster(cut, "sentences", embedder=embedder, batch_size=batch_size, fixed_threshold=fixed_threshold, c=c, init_constant=init_constant)

    try:
        return _run(spark, "maxmin", input, "*.txt", texts_of, make, lambda d: maxmin.to_chunks(d, "sentences", "starts", "source_file", include_metadata), output, skip_existing, "starts", only, log_dir, files_to)
    finally:
        for model in models:
            model.forget()
        for docs in held:
            docs.unpersist()


def chunk_elements(spark: SparkSession, input: str, output: str, *, partitioner: Callable = elements.html_partitioner, pattern: str = "*.html", strategy: str | None = None, languages: Sequence[str] | None = None, measure: Callable | None = None, partitioners: dict[str, tuple[float, Callable]] | None = None, include_metadata: bool = True, skip_existing: bool = True, only: str | None = None, log_dir: str | None = None, files_to: str | None = None) -> DataFrame:
    """Files to one chunk for each element; PDF files with ``pattern="*.pdf"`` and a partitioner of their bytes.

    ``strategy`` and ``languages`` are handed to the partitioner, where they are given. With ``strategy="auto"`` and ``measure``,
    each file goes to the one of ``partitioners`` that its share of text asks for (``elements.route``).
    """
    options = {k: v for k, v in (("strategy", strategy), ("languages", languages)) if v is not None}
    content = F.col("content") if pattern == "*.pdf" else F.decode("content", "UTF-8")
    if strategy == "auto" and measure is not None:
        own = {k: v for k, v in options.items() if k != "strategy"}
        routes = {name: (least, partial(p, **own) if own else p) for name, (least, p) in (partitioners or {}).items()}
        make = lambda d: elements.route(d, "content", "source_file", measure, routes)
    else:
        make = lambda d: elements.partition(d, "content", "source_file", partitioner=partial(partitioner, **options) if options else partitioner)
    read = lambda files: files.select("source_file", content.alias("content"), *(c for c in files.columns if c == "read_error"))
    return _run(spark, "element", input, pattern, read, make, lambda d: elements.to_chunks(d, "source_file", include_metadata), output, skip_existing, "elements", only, log_dir, files_to)
