"""Command line: ``python -m folioweave.plans.cli JOB [options]``; exit code 0 if anything was processed."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from folioweave.operators import embed, models
from folioweave.operators.cache import Cache
from folioweave.plans import jobs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="folioweave")
    sub = out.add_subparsers(dest="job", required=True)

    def job(name: str, source: str, target: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--input", "-i", default=source)
        p.add_argument("--output", "-o", default=target)
        p.add_argument("--no-skip", action="store_true")
        p.add_argument("--single", *(["-s"] if name in ("preprocess", "recursive") else []), help="name or path of the one file of the input directory to do, done before or not")
        p.add_argument("--log-dir", help="directory for the run's log")
        p.add_argument("--files", help="folder for a file of each document's result, beside the table")
        return p

    p = job("preprocess", "data/raw", "data/cleaned")
    p.add_argument("--metadata", "-m", action="store_true")
    p.add_argument("--extractor", required=True, help="module:function from a file's bytes to (pages, properties)")
    p = job("recursive", "data/cleaned", "data/chunked/recursive")
    p.add_argument("--chunk-size", "-c", type=int, default=1000)
    p.add_argument("--overlap", type=int, default=200)
    p.add_argument("--no-metadata", action="store_true")
    p = job("maxmin", "data/cleaned", "data/chunked/maxmin_semantic")
    for flags, default in ((("--threshold", "-t"), 0.6), (("--c",), 0.9), (("--init",), 1.5)):
        p.add_argument(*flags, type=float, default=default)
    p.add_argument("--batch-size", type=int, default=8)
    p.add_argument("--gguf", default=models.GGUF, help="file of a quantised model, which is what embeds unless another choice is made")
    p.add_argument("--no-gguf", action="store_true", help="a model by name instead")
    p.add_argument("--n-gpu-layers", type=int, default=-1)
    p.add_argument("--model", "-m", default=models.NAMED)
    p.add_argument("--device", choices=("cpu", "cuda"), default="cuda")
    p.add_argument("--low-memory", action="store_true", help="half precision, for a model by name")
    p.add_argument("--sentences", choices=("learnt", "pattern"), default="learnt", help="boundaries learnt from the texts, or at every full stop")
    p.add_argument("--learn-from", help="directory of texts to learn sentence boundaries from, if not those that are done")
    p.add_argument("--cache", help="folder of embeddings that are kept by sentence and model")
    p.add_argument("--embedder", help="module:function that loads any other model, such as folioweave.operators.embed:hashing")
    p.add_argument("--no-metadata", action="store_true")
    p = job("element", "data/raw", "data/chunked/element_based")
    p.add_argument("--strategy", "-s", choices=("auto", "hi_res", "fast", "ocr_only"), default="hi_res", help="for the partitioner")
    p.add_argument("--languages", nargs="*", default=["ind"], help="for the partitioner")
    p.add_argument("--partitioner", help="module:function from a file's bytes to elements; HTML files without it")
    p.add_argument("--measure", help="module:function from a file's bytes to its share of text, by which --strategy auto chooses")
    p.add_argument("--route", nargs=3, action="append", metavar=("NAME", "SHARE", "MODULE:FUNCTION"), help="for --measure: a strategy, the least share of text, and its partitioner")
    p.add_argument("--no-metadata", action="store_true")
    return out


def named(path: str | None):
    if path is None:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def embedder(a: argparse.Namespace) -> embed.Loader:
    """The loader that the options ask for."""
    if a.embedder:
        return named(a.embedder)
    if a.no_gguf:
        return models.sentence_transformer(a.model, device=a.device, low_memory=a.low_memory, batch_size=a.batch_size)
    return models.gguf(a.gguf, n_gpu_layers=a.n_gpu_layers)


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    only = a.single.rsplit("/", 1)[-1] if a.single else None
    common = {"skip_existing": not a.no_skip, "only": only, "log_dir": a.log_dir, "files_to": a.files}
    if a.job == "preprocess":
        stats = jobs.preprocess(spark, a.input, a.output, extractor=named(a.extractor), save_metadata=a.metadata, **common)
    elif a.job == "recursive":
        stats = jobs.chunk_recursive(spark, a.input, a.output, chunk_size=a.chunk_size, chunk_overlap=a.overlap, include_metadata=not a.no_metadata, **common)
    elif a.job == "maxmin":
        kept = Cache(spark, a.cache, a.embedder or (a.model if a.no_gguf else a.gguf)) if a.cache else None
        stats = jobs.chunk_maxmin(spark, a.input, a.output, embedder=embedder(a), sentences=a.sentences, learn_from=a.learn_from, cache=kept, fixed_threshold=a.threshold, c=a.c, init_constant=a.init, batch_size=a.batch_size, include_metadata=not a.no_metadata, **common)
    else:
        plug = {"partitioner": named(a.partitioner), "pattern": "*.pdf", "strategy": a.strategy, "languages": a.languages} if a.partitioner else {}
        if a.measure:
            routes = {name: (float(least), named(path)) for name, least, path in a.route or ()}
            plug = {"pattern": "*.pdf", "strategy": a.strategy, "languages": a.languages, "measure": named(a.measure), "partitioners": routes}
        stats = jobs.chunk_elements(spark, a.input, a.output, include_metadata=not a.no_metadata, **plug, **common)
    row = stats.first()
    print(row.asDict())
    return 0 if row["processed"] > 0 else 1


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("folioweave").getOrCreate(), sys.argv[1:]))
