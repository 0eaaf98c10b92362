"""Benchmark decontamination with one Aho-Corasick automaton.

A window is 13 consecutive words of a benchmark text (a shorter text is one window). The automaton holds, as normalised
bytes, anchors of 5 words at every 9th place of each text, one of which lies whole in any window, and the shorter texts
themselves. Each document is scanned once. Around an anchor that it holds, its windows of 13 words are looked up by a
hash that tells all the benchmark's windows apart, and compared byte by byte. Hits are mapped back to the document's own
words and UTF-8 offsets. So the automaton takes less than the benchmark's own size in states, however long the windows.

Normalising maps each ASCII byte that is no word byte to a space and A-Z to a-z, so it keeps byte offsets. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after that.

Bounds: the benchmark's size is asked for before any of it is collected. Up to PASS bytes are broadcast, and each worker
builds the automaton once; of a larger benchmark each further PASS bytes are scanned for in one more pass over the documents. A
pass then keeps what it finds alone, by the hash of the text; texts are neither written nor carried from pass to pass, and
what all passes found is joined with the documents at the end.

Cases: a null or wordless document has no words, no hits and no items; a null or wordless item has no windows; an item
repeated under one id counts once; items without an id make hits but are not listed; repeated documents are judged each;
columns of ``docs`` that have the names of new ones are replaced; no documents give no rows, no items no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import handed, map_texts, materialise, slices, texts_as_bytes

WINDOW, ANCHOR = 13, 5
#: UTF-8 bytes of benchmark texts that one pass over the documents scans for.
PASS = 16 << 20

Items = list[tuple[str | None, bytes]]

_WORD = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(i if i in _WORD else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("hit_from", T.ArrayType(T.LongType(), False), False),
        T.StructField("hit_to", T.ArrayType(T.LongType(), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("byte_from", T.ArrayType(T.LongType(), False), False),
        T.StructField("byte_to", T.ArrayType(T.LongType(), False), False),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The distinct windows of some items, sorted by hash, and the patterns of the automaton that finds them."""

    def __init__(self, items: Items, window: int = WINDOW):
        self.ready: ahocorasick.Automaton | None = None
        self.window, self.anchor = window, min(ANCHOR, window)
        lines, at, names, owner, start, stop, short = [], 0, {}, [], [], [], []
        anchors: dict[bytes, tuple[int, int]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            line = b" " + b" ".join(words) + b" "
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            size = min(window, len(words))
            n = len(words) - size + 1
            owner.append(np.full(n, -1 if item is None else names.setdefault(item, len(names))))
            start.append(at + gaps[:n])
            stop.append(at + gaps[size:] + 1)
            short.append(np.full(n, size if size < window else 0))
            if size == window:
                places = range(0, len(words) - self.anchor + 1, window - self.anchor + 1)
                anchors.update((line[gaps[i] : gaps[i + self.anchor] + 1], (at + int(gaps[i]), at + int(gaps[i + self.anchor]) + 1)) for i in places)
            lines.append(line)
            at += len(line)
        self.data, self.ids = b"".join(lines), list(names)
        none = [np.zeros(0, np.int64)]
        owner, start, stop, short = (np.concatenate(x or none) for x in (owner, start, stop, short))
        self.seed, order, first = self._told_apart(start, stop)
        self.start, self.stop, short = start[order][first], stop[order][first], short[order][first]
        of = np.cumsum(first) - 1
        pairs = np.unique(np.stack([of, owner[order]], axis=1)[owner[order] >= 0], axis=0)
        self.items, self.first_item = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        # short items as (start, stop, words, number), anchors as (start, stop, number of the short item that is the same or -1)
        self.short = [(a, b, n, k) for k, (a, b, n) in enumerate(zip(self.start.tolist(), self.stop.tolist(), short.tolist(), strict=True)) if n]
        same = {self.data[a:b]: k for a, b, _, k in self.short}
        self.spans = [(a, b, same.get(text, -1)) for text, (a, b) in anchors.items()]

    def _told_apart(self, start: np.ndarray, stop: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """A seed under which only equal windows have equal hashes, the windows' order by it, and the first of each; sets the hashes."""
        for seed in range(64):
            hashes = np.fromiter((xxhash.xxh64_intdigest(self.data[a:b], seed) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
            order = np.argsort(hashes, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = hashes[order[1:]] != hashes[order[:-1]]
            again = np.flatnonzero(~first)
            a, b, c, d = (x.tolist() for x in (start[order[again]], stop[order[again]], start[order[again - 1]], stop[order[again - 1]]))
            if all(self.data[w:x] == self.data[y:z] for w, x, y, z in zip(a, b, c, d, strict=True)):
                self.hashes = hashes[order][first]
                return seed, order, first
        raise ValueError("no seed tells the windows apart")

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns as latin-1; a value is (words, window of a short item or -1, whether it is an anchor)."""
        out = ahocorasick.Automaton()
        for a, b, n, k in self.short:
            out.add_word(self.data[a:b].decode("latin-1"), (n, k, False))
        for a, b, k in self.spans:
            out.add_word(self.data[a:b].decode("latin-1"), (self.anchor, k, True))
        if len(out):
            out.make_automaton()
        return out

    def among(self, line: bytes, gaps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows that start at these words of ``line`` are the benchmark's: their starts and numbers."""
        spans = list(zip(gaps[starts].tolist(), (gaps[starts + self.window] + 1).tolist(), strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], self.seed) for a, b in spans), np.uint64, len(spans))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = [j for j in np.flatnonzero(self.hashes[at] == hashes).tolist() if line[slice(*spans[j])] == self.data[self.start[at[j]] : self.stop[at[j]]]]
        return starts[same], at[same]


Found = tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]


def scan(windows: Windows, found: ahocorasick.Automaton, text: bytes) -> Found:
    """Number of words, maximal hit runs of words [from, to), items, and the same runs as UTF-8 offsets of ``text``."""
    folded = text.translate(_FOLD)
    words = folded.split()
    nothing = (len(words), [], set(), [])
    if not words or not len(found):
        return nothing
    line = b" " + b" ".join(words) + b" "
    hits = list(found.iter(line.decode("latin-1")))
    if not hits:
        return nothing
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    cover, near = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 2, np.int64)
    last = len(words) - windows.window
    numbers = []
    for e, (_, (n, k, anchor)) in zip(np.searchsorted(gaps, [end for end, _ in hits]).tolist(), hits, strict=True):
        if k >= 0:
            cover[e - n] += 1
            cover[e] -= 1
            numbers.append(k)
        if anchor and last >= 0:
            near[max(0, e - windows.window)] += 1
            near[max(0, min(e - n, last) + 1)] -= 1
    starts, those = windows.among(line, gaps, np.flatnonzero(np.cumsum(near[: len(words)]) > 0))
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + windows.window, -1)
    numbers = np.unique(np.concatenate([np.array(numbers, np.int64), those]))
    if not len(numbers):
        return nothing
    runs = _runs(cover)
    named = {windows.ids[i] for k in numbers.tolist() for i in windows.items[windows.first_item[k] : windows.first_item[k + 1]].tolist()}
    return len(words), runs, named, _offsets(folded, runs)


def _runs(cover: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words; ``cover`` has what begins and ends at each."""
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _offsets(folded: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets."""
    inside = np.diff((np.frombuffer(b" " + folded + b" ", np.uint8) != 32).astype(np.int8))
    from_, to = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    return [(int(from_[a]), int(to[b - 1])) for a, b in runs]


def find(docs: DataFrame, parts: Iterable[Items], text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the columns of FOUND: what of each text lies in windows of the benchmark's items, (id, UTF-8 text).

    Each of ``parts`` is one pass over the texts.
    """
    parts = iter(parts)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _pass(docs, Windows(first, window), text)
    hits = [materialise(_hits(docs, Windows(items, window), text)) for items in chain([first, second], parts)]
    return _merged(docs, reduce(DataFrame.unionByName, hits), text)


def _scanner(docs: DataFrame, windows: Windows):
    sent = handed(docs.sparkSession, windows)

    def make():
        windows = sent()  # a worker keeps it for its later tasks, and so the automaton
        if windows.ready is None:
            windows.ready = windows.automaton()
        return lambda text: scan(windows, windows.ready, text)

    return make


def _columns(got: list[Found]) -> list[pa.Array]:
    return [
        pa.array([x[0] for x in got], pa.int64()),
        *(pa.array([[r[k] for r in x[1]] for x in got], pa.list_(pa.int64())) for k in (0, 1)),
        pa.array([sorted(x[2]) for x in got], pa.list_(pa.string())),
        *(pa.array([[r[k] for r in x[3]] for x in got], pa.list_(pa.int64())) for k in (0, 1)),
    ]


def _pass(docs: DataFrame, windows: Windows, text: str) -> DataFrame:
    scanner = _scanner(docs, windows)

    def make():
        found = scanner()
        return lambda batch: _columns([found(t) for t in texts_as_bytes(batch.column(text))])

    return map_texts(docs, text, FOUND, make)


def _hits(docs: DataFrame, windows: Windows, text: str) -> DataFrame:
    """Hash, runs and items of the texts that hold any of the windows, once each."""
    scanner = _scanner(docs, windows)

    def run(batches):
        found = scanner()
        for batch in slices(batches, "text"):
            texts = texts_as_bytes(batch.column("text"))
            got = [(hashlib.sha256(t).hexdigest(), x) for t in texts if (x := found(t))[1]]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.string()), *_columns([x for _, x in got])[1:4]], names=["_text", "_from", "_to", "_items"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "_text string, _from array<long>, _to array<long>, _items array<string>")
    return rows.groupBy("_text").agg(*(F.first(c).alias(c) for c in ("_from", "_to", "_items")))


def _merged(docs: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """``docs`` with what several passes have found in their texts; a text has one row of each pass at most."""
    own = hits.groupBy("_text").agg(F.flatten(F.collect_list("_from")).alias("_from"), F.flatten(F.collect_list("_to")).alias("_to"), F.flatten(F.collect_list("_items")).alias("_items"))
    joined = docs.join(own, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256) == F.col("_text"), "left")

    def make():
        def run(batch):
            got = []
            for t, from_, to, items in zip(texts_as_bytes(batch.column(text)), *(batch.column(c).to_pylist() for c in ("_from", "_to", "_items")), strict=True):
                folded = t.translate(_FOLD)
                n = len(folded.split())
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, from_ or [], 1)
                np.add.at(cover, to or [], -1)
                runs = _runs(cover)
                got.append((n, runs, set(items or ()), _offsets(folded, runs)))
            return _columns(got)

        return run

    return map_texts(joined, text, FOUND, make).drop("_text", "_from", "_to", "_items")


def benchmark_items(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's rows, in as many parts, each by itself on the driver, as PASS asks for by the size of all."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PASS))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r[0], (r[1] or "").encode()) for r in part.collect()]


def judged(found: DataFrame) -> DataFrame:
    """FOUND as n_hit, n_items, items_sha256 and contaminated: a twentieth of the words, and at least one, is hit."""
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
