"""Token counts without token ids.

A text falls into pre-tokens that no piece of the vocabulary crosses. Pieces are counted once for each distinct
pre-token of the corpus; each text's pre-token frequencies are joined with these counts and summed. The most frequent
pre-tokens (HOT at most, and HOT_BYTES of short ones) are joined inside the scan from a broadcast of that bound, all others by a shuffle join.

Cases: a null or empty text has 0 tokens; repeated rows are counted each; texts are read whole, and one without spaces
or line ends is one pre-token; an empty table gives no rows; columns of the names ``n_bytes``, ``n_tokens``, ``_row``,
``_known``, ``_rest`` and ``_more`` are replaced or dropped, all others but the text are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import map_texts, materialise, slices, texts_as_bytes

#: Bounds: pre-tokens that are broadcast, their bytes, and distinct pre-tokens and their bytes that a task holds before it passes them on.
HOT, HOT_BYTES, HELD, HELD_BYTES = 400_000, 32 << 20, 200_000, 32 << 20
#: Bytes of a pre-token that may be broadcast.
SHORT = 1024
#: Frequencies are told apart by eighths of a power of two when the hot pre-tokens are chosen.
STEPS = 8

_MARK = "▁"
_PARTS = re.compile(" +[^ \n]*|\n+|[^ \n]+")


class Pieces:
    """Pre-tokens and their numbers of pieces for a sentencepiece model; one in a task."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(self.model.vocab_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        pieces = [self.model.id_to_piece(i) for i in plain]
        same = all(self.model.normalize(x) == (_MARK + x).replace(" ", _MARK) for x in ("a  b ", " Åﬁ\n\tx", "x"))
        #: Whether spaces start pieces only and line ends are in none, under a normalizer that only marks spaces.
        self.cut = same and not any(_MARK in p.lstrip(_MARK) or "\n" in p or " " in p for p in pieces)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return _PARTS.findall(" " + text.replace(_MARK, " ")) if self.cut else [text]

    def count(self, parts: list[str]) -> list[int]:
        if not self.cut:
            return [len(x) for x in self.model.encode(parts, num_threads=1)]
        # a space that starts a part is the one that the model puts before any text; other parts go behind a line end
        asked = [p[1:] if p[0] == " " else "\n" + p for p in parts]
        found = self.model.encode(asked, num_threads=1)
        return [1 if p == " " else len(x) - (0 if p[0] == " " else 2) for p, x in zip(parts, found, strict=True)]


def pieces_of(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each distinct pre-token of the corpus: ``part``, its frequency ``n`` and its number of ``pieces``."""

    def gather(batches):
        pieces, held, size = Pieces(path), Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["part", "n"])

        for batch in slices(batches, text):
            for t in texts_as_bytes(batch.column(text)):
                held.update(pieces.split(t.decode("utf-8", "replace")))
                size += len(t)
                if len(held) > HELD or (size > HELD_BYTES and (size := sum(map(len, held))) > HELD_BYTES):
                    yield out()
                    held, size = Counter(), 0
        if held:
            yield out()

    def count(batches):
        pieces = Pieces(path)
        for batch in slices(batches, "part"):
            counts = pieces.count(batch.column("part").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("n"), pa.array(counts, pa.int64())], names=["part", "n", "pieces"])

    distinct = docs.select(text).mapInArrow(gather, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return materialise(distinct.mapInArrow(count, "part string, n long, pieces long"))


def _hot(parts: DataFrame) -> tuple[dict[str, int], float]:
    """The most frequent of the short pre-tokens, at most HOT and HOT_BYTES of them, and the step of frequencies from which they are."""
    step, size = F.floor(F.log2("n") * STEPS), F.octet_length("part")
    short = parts.where(size <= SHORT)
    least, total, total_bytes = math.inf, 0, 0
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.sum(size)).collect(), reverse=True):
        total, total_bytes = total + r[1], total_bytes + r[2]
        if total > HOT or total_bytes > HOT_BYTES:
            break
        least = r[0]
    rows = short.where(step >= least).select("part", "pieces").toArrow() if least < math.inf else None
    return (dict(zip(rows["part"].to_pylist(), rows["pieces"].to_pylist(), strict=True)) if rows is not None else {}), least


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    parts = pieces_of(docs, path, text)
    hot, least = _hot(parts)
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    fields = T.StructType(
        [
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField("_known", T.LongType(), False),
            T.StructField("_rest", T.MapType(T.StringType(), T.LongType(), False), False),
        ]
    )

    def make():
        pieces, known = Pieces(path), sent.value

        def run(batch):
            sizes, sums, rests = [], [], []
            for raw in texts_as_bytes(batch.column(text)):
                found = pieces.split(raw.decode("utf-8", "replace"))
                values = list(map(known.get, found))
                sizes.append(len(raw))
                sums.append(sum(filter(None, values)))
                rests.append(Counter(p for p, v in zip(found, values, strict=True) if v is None) if None in values else {})
            return [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array([list(r.items()) for r in rests], pa.map_(pa.string(), pa.int64()))]

        return run

    counted = map_texts(docs, text, fields, make).drop(text)
    counted = materialise(counted.withColumn("_row", F.monotonically_increasing_id()))
    rest = counted.where(F.size("_rest") > 0).select("_row", F.explode("_rest").alias("part", "_times"))
    cold = parts.where((F.floor(F.log2("n") * STEPS) < least) | (F.octet_length("part") > SHORT)) if least < math.inf else parts
    cold = cold.select("part", "pieces")
    sums = rest.join(cold, "part").groupBy("_row").agg(F.sum(F.col("_times") * F.col("pieces")).alias("_more"))
    total = (F.col("_known") + F.coalesce(F.col("_more"), F.lit(0))).cast("long")
    return counted.drop("_rest").join(sums, "_row", "left").withColumn("n_tokens", total).drop("_row", "_known", "_more")
