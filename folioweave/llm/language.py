"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted
(rolled) by their places; a text's vector bundles (sums) those of its trigrams; a language's prototype bundles the unit
vectors of its texts. A text gets the language whose prototype has the largest cosine with it.

Letters are folded to lower case and to 128 slots, ``a`` to ``z`` and other Latin letters apart, all others by code
point; everything else is one word boundary, which is a letter too.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learnt; ties go to
the language first in alphabetical order; repeated rows are judged each; texts of any length are read whole; an empty
table gives no rows; columns ``lang_pred`` and ``score`` are replaced, all others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import map_texts, slices, texts_as_bytes

DIMENSIONS, SLOTS, SEED = 1024, 128, 20240607
#: About so many texts of a language are learnt from, at most; which ones is decided by a hash of their ids.
SAMPLE = 4000
UNKNOWN = "und"
#: Texts of one slice, and trigrams bound at once: bounds of a task's memory.
SLICE, CHUNK = 1 << 20, 4096


def _pieces(text: bytes, size: int = SLICE) -> list[bytes]:
    """A text cut at spaces into pieces of about ``size`` bytes; a space is a word boundary on either side."""
    at, out = 0, []
    while len(text) - at > size:
        end = text.rfind(b" ", at + 1, at + size)
        end = end if end > 0 else text.find(b" ", at + size)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class Profiler:
    """Vectors of texts; one in a task."""

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(SEED)
        letters = rng.integers(0, 2, (SLOTS, dimensions)).astype(np.float32) * 2 - 1
        self.rolled = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.slots = np.full(0x110000, -1, np.int16)
        self.row = np.zeros(SLOTS**3, np.int32)
        self.dimensions = dimensions

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Slots of code points, 0 for what is no letter."""
        found = self.slots[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]).tolist():
                c = chr(p)
                low = c.lower()[:1]
                self.slots[p] = 0 if not c.isalpha() else ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SLOTS - 27)
            found = self.slots[points]
        return found

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its vector, and whether it has a letter; long texts in pieces, whose vectors add up."""
        pieces = [(k, p) for k, t in enumerate(texts) for p in _pieces(t)]
        if len(pieces) == len(texts):
            return self._vectors(texts)
        out, lettered = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), bool)
        for k, p in pieces:
            vector, has = self._vectors([p])
            out[k] += vector[0]
            lettered[k] |= has[0]
        return out, lettered

    def _vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for t in texts]
        sizes = np.array([len(p) + 1 for p in points])
        everything = np.zeros(sizes.sum() + 1, np.uint32)
        at = 1
        for p in points:  # each text between two boundaries
            everything[at : at + len(p)] = p
            at += len(p) + 1
        slot = self.letters(everything).astype(np.int32)
        slot[0] = slot[np.cumsum(sizes)] = 0
        owner = np.repeat(np.arange(len(texts)), sizes)
        keep = np.ones(len(slot), bool)
        keep[1:] = (slot[1:] != 0) | (slot[:-1] != 0)
        owner, slot = np.concatenate([[0], owner])[keep], slot[keep]
        lettered = np.bincount(owner, slot != 0, len(texts)) > 0
        grams = (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]
        inside = (slot[1:-1] != 0) & (owner[:-2] <= owner[2:])
        grams, owner = grams[inside], owner[1:-1][inside]
        self.row[grams] = 1
        known = np.flatnonzero(self.row)
        self.row[known] = np.arange(len(known))
        rows = self.row[grams]
        self.row[known] = 0
        for a in range(0, len(known), CHUNK):
            part = known[a : a + CHUNK]
            bound = self.rolled[0][part // SLOTS**2] * self.rolled[1][part // SLOTS % SLOTS] * self.rolled[2][part % SLOTS]
            here = slice(None) if len(known) <= CHUNK else (rows >= a) & (rows < a + CHUNK)
            counts = np.bincount(owner[here] * len(part) + (rows[here] - a), minlength=len(texts) * len(part))
            out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
        return out, lettered


def groups(batches, text: str):
    """Slices of few texts, so that counts of texts by trigrams stay small."""
    for part in slices(batches, text, SLICE):
        for a in range(0, part.num_rows, 512):
            yield part.slice(a, 512)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes, from about ``sample`` texts of each with a text and a language."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return [], np.zeros((0, dimensions), np.float32)
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, min(1.0, sample / n)).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < share * (1 << 20)).select(text, lang)

    def run(batches):
        profiler, sums = Profiler(dimensions), {}
        for part in groups(batches, text):
            vectors, lettered = profiler.vectors(texts_as_bytes(part.column(text)))
            unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for name, v, ok in zip(part.column(lang).to_pylist(), unit, lettered, strict=True):
                if ok:
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["name", "bundle"])

    totals: dict[str, np.ndarray] = {}
    for r in sorted(chosen.mapInArrow(run, "name string, bundle binary").collect(), key=lambda r: (r[0], bytes(r[1]))):
        totals[r[0]] = totals.get(r[0], 0) + np.frombuffer(r[1])
    names = sorted(totals)
    prototypes = np.array([totals[n] / max(np.linalg.norm(totals[n]), 1e-9) for n in names], np.float32).reshape(len(names), dimensions)
    return names, prototypes


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the language's prototype, at least 0."""
    fields = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def make():
        profiler = Profiler(prototypes.shape[1])

        def run(batch):
            best, scores = [], []
            for a in range(0, batch.num_rows, 512):
                vectors, lettered = profiler.vectors(texts_as_bytes(batch.column(text).slice(a, 512)))
                if len(names):
                    cosines = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    at = cosines.argmax(axis=1)
                    best += [names[k] if ok else UNKNOWN for k, ok in zip(at, lettered, strict=True)]
                    scores.append(np.where(lettered, np.clip(cosines[np.arange(len(at)), at], 0, 1), 0))
                else:
                    best += [UNKNOWN] * len(vectors)
                    scores.append(np.zeros(len(vectors)))
            return [pa.array(best, pa.string()), pa.array(np.concatenate(scores).astype(np.float64))]

        return run

    return map_texts(docs, text, fields, make, SLICE)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; of a null key as of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
