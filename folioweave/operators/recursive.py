"""Size-bounded chunks with overlap, cut at the coarsest separator that will do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.functions.cleaning import strip
from folioweave.operators.rows import each

# Separators from paragraphs down to characters
SEPARATORS = ("\n\n", "\n", " ", "")
METHOD = "recursive_character_text_splitter"
#: Texts whose chunks are held as Python objects at a time.
PART = 64


def _pieces(text: str, separator: str) -> list[str]:
    """``text`` cut before each match of the separator's pattern; all characters if there is no separator."""
    if not separator:
        return list(text)
    cuts = [0, *(m.start() for m in re.finditer(separator, text) if m.end() > m.start()), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _merged(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> Iterator[str]:
    """Windows of consecutive pieces of at most ``size``, each starting with pieces of the one before of at most ``overlap``."""
    sizes = [length(p) for p in pieces]
    start = total = 0
    for end, n in enumerate(sizes):
        if total + n > size and end > start:
            yield "".join(pieces[start:end])
            while total > overlap or (total + n > size and total > 0):
                total -= sizes[start]
                start += 1
        total += n
    yield "".join(pieces[start:])


def split_text(text: str, size: int, overlap: int, separators: Sequence[str], length: Callable[[str], int]) -> list[str]:
    """Chunks of one text; separators are patterns."""
    at = next((k for k, s in enumerate(separators) if not s or re.search(s, text)), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        out.extend(c for c in (w.strip() for w in _merged(small, size, overlap, length)) if c)
        small.clear()

    for piece in _pieces(text, separators[at]):
        if length(piece) < size:
            small.append(piece)
            continue
        flush()
        out.extend(split_text(piece, size, overlap, finer, length) if finer else [piece])
    flush()
    return out


def split(text: Column, *, chunk_size: int = 1000, chunk_overlap: int = 200, separators: Sequence[str] | None = None, is_separator_regex: bool = False, length_function: Callable[[str], int] = len) -> Column:
    """Chunks of ``text`` as an array; null for a null text, and for all if the overlap is larger than the chunks."""
    if chunk_overlap > chunk_size:
        return F.lit(None).cast("array<string>")
    given = list(SEPARATORS if separators is None else separators)
    if given == [""] and length_function is len and 0 <= chunk_overlap < chunk_size:
        return windows(text, chunk_size=chunk_size, chunk_overlap=chunk_overlap)
    patterns = given if is_separator_regex else [re.escape(s) for s in given]
    kind = pa.list_(pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pa.Array) -> pa.Array:
        # chunks of PART texts are Python objects at a time; the rest of a batch are bytes
        parts = [pa.array([None if t is None else split_text(t, chunk_size, chunk_overlap, patterns, length_function) for t in texts.slice(a, PART).to_pylist()], kind) for a in range(0, len(texts), PART)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # else the optimiser puts filters on the chunks below other steps, and has Python make them once more for each
    return chunks.asNondeterministic()(text)


def windows(text: Column, *, chunk_size: int = 1000, chunk_overlap: int = 200) -> Column:
    """What ``split`` gives for the one separator "": windows of equal size, as built-in functions."""
    step = chunk_size - chunk_overlap
    if step < 0:
        return F.lit(None).cast("array<string>")
    n = F.length(text)
    many = F.when(n <= chunk_size, 1).otherwise(1 + F.ceil((n - chunk_size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda k: strip(F.substring(text, k * step + 1, F.lit(chunk_size))))
    return F.when(text.isNull(), F.lit(None)).when(n == 0, F.array().cast("array<string>")).otherwise(F.filter(cut, lambda c: F.length(c) > 0))


def to_chunks(docs: DataFrame, chunks: str, source: str, include_metadata: bool = True) -> DataFrame:
    """A row for each chunk of the array column ``chunks``: ``source``, chunk_id, text, num_characters, metadata."""
    rows = each(docs, chunks, source, place="chunk_id", value="text").withColumn("num_characters", F.length("text"))
    metadata = F.struct(F.col(source).cast("string").alias("source_file"), F.lit(METHOD).alias("chunking_method"), F.col("num_characters").alias("chunk_length"))
    return rows.withColumn("metadata", metadata) if include_metadata else rows


def structs(chunks: Column, source: Column, include_metadata: bool = True) -> Column:
    """What ``to_chunks`` makes of ``chunks``, as an array of structs (chunk_id, text, num_characters, metadata)."""
    own = lambda text: F.struct(source.cast("string").alias("source_file"), F.lit(METHOD).alias("chunking_method"), F.length(text).alias("chunk_length")).alias("metadata")
    return F.transform(chunks, lambda text, k: F.struct(k.alias("chunk_id"), text.alias("text"), F.length(text).alias("num_characters"), *([own(text)] if include_metadata else [])))
