"""Collocations by Suffix-sigma.

A text falls into pieces at punctuation and line ends, a piece into words. From every word on, the next ``max_n`` words of
its piece are a suffix. Tasks count the distinct suffixes of a slice of texts, and send them, with a dictionary of the
words in them, to buckets chosen by language and first word. A bucket puts its suffixes into reverse lexicographic order;
then all suffixes that begin with one phrase are neighbours, and one stack counts the phrases of every length: a phrase is
pushed where it begins to differ from the suffix before, and popped, with the sum of all in between, where it ends. The stack
is kept as arrays, a level to each length.

A first word that many suffixes share would fill one bucket, so its suffixes are dealt over buckets by their second word
too, and those of a pair that is as frequent by their third. Which words and pairs these are is asked of a sample of texts; it
decides on places alone. What is counted in several buckets is summed afterwards. Beyond WIDEST buckets (64 GB of text) the list
of such words would grow too long to be sent to all tasks, and every suffix is dealt by all its words.

Counts are then joined: each phrase with the counts of its first words and of the rest, for each place to cut it. A phrase
scores 1,000,000 a² / (l r), rounded down, of its lowest cut, in decimals of 38 digits: exact while a count has at most 15 digits.

Cases: a null or empty text has no words; a null language is ``und`` and one with a row so named; a text of any length is
read whole; repeated rows count each; languages without a phrase give no rows, nor does an empty table; columns beside text and
language are left out, whatever their names; equal scores go by count and then by the phrase's bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.common import lookup, materialise, slices

#: What ends a piece
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text whose suffixes are counted together, for which a bucket is made, and that the sample has.
SLICE, BUCKET, SAMPLE = 8 << 20, 4 << 20, 64 << 20
#: Buckets for each of Spark's shuffle partitions at least; the share of a bucket's mean from which a word is dealt by its second, too.
SPREAD, HOT = 4, 0.25
#: Buckets up to which frequent prefixes are told from others; they are max_n * WIDEST / HOT at most.
WIDEST = 1 << 14
#: Parts into which a language's phrases are ranked before all of them are.
RANKED = 64

_BREAK = b"."
_FOLD = bytes(_BREAK[0] if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def packed(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row, in the rows' order; column k has numbers below ``sizes[k]``."""
    code, most = columns[0].astype(np.uint64), sizes[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if most * size >= 1 << 63:
            known, code = np.unique(code, return_inverse=True)
            code, most = code.astype(np.uint64), len(known)
        code, most = code * np.uint64(size) + column.astype(np.uint64), most * size
    return code


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in the order of their bytes, and each place's number among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def binaries(data: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of bytes that are ``inside``, as an Arrow array, and where they begin."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), starts


def suffixes(texts: list[bytes], langs: list[str], max_n: int) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray]:
    """Languages, words, the distinct suffixes (rows of language, then numbers of words from 1, 0 for none) and their counts."""
    data = np.frombuffer(_BREAK.join([*texts, b""]).translate(_FOLD), np.uint8)
    found, starts = binaries(data, (data != 32) & (data != _BREAK[0]))
    words, ids = ranked(found)
    ids = np.append(ids.astype(np.int32) + 1, np.zeros(max_n, np.int32))
    # two words are in one piece if no break lies between them
    piece = np.append(np.searchsorted(np.flatnonzero(data == _BREAK[0]), starts), np.full(max_n, -1))
    names = sorted(set(langs))
    numbers = {x: k for k, x in enumerate(names)}
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    n = len(starts)
    columns = [np.array([numbers[x] for x in langs], np.int32)[text], ids[:n]]
    columns += [np.where(piece[k : n + k] == piece[:n], ids[k : n + k], 0) for k in range(1, max_n)]
    _, first, count = np.unique(packed(columns, [len(names), *[len(words) + 1] * max_n]), return_index=True, return_counts=True)
    return names, words, np.stack([c[first] for c in columns]), count


def hashes(names: list[str], words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each language, and for each number of a word."""
    of = lambda values: np.fromiter(map(xxhash.xxh64_intdigest, values), np.uint64, len(values))
    return of([x.encode() for x in names]), np.append(np.zeros(1, np.uint64), of(words.to_pylist()))


def joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of what ``h`` and then ``more`` are hashes of."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + more
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def among(h: np.ndarray, held: np.ndarray | None) -> np.ndarray:
    """Which of ``h`` are in ``held``, which is sorted; all if there is none."""
    if held is None:
        return np.ones(len(h), bool)
    return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h if len(held) else np.zeros(len(h), bool)


def routed(lang: np.ndarray, word: np.ndarray, rows: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """A hash for each suffix that says where it goes: of language and first word, and of a word more behind each hot prefix."""
    h = joined(lang[rows[0]], word[rows[1]])
    more = np.ones(len(h), bool)
    for column in rows[2:]:
        more &= among(h, hot)
        if not more.any():
            break
        h[more] = joined(h[more], word[column[more]])
    return h


def prefix_counts(rows: np.ndarray, sizes: list[int], counts: np.ndarray):
    """For each length from 0 (the language) the suffixes that stand for the distinct prefixes of that length, and the prefixes' counts."""
    order = np.argsort(packed(list(rows), sizes))[::-1]
    rows, counts = rows[:, order], counts[order]
    running = np.append(0, np.cumsum(counts))
    differs = np.zeros(rows.shape[1], bool)
    differs[:1] = True
    for k, column in enumerate(rows):
        differs[1:] |= column[1:] != column[:-1]
        pushed = np.flatnonzero(differs)
        popped = np.append(pushed[1:], len(differs))
        whole = column[pushed] > 0 if k else np.ones(len(pushed), bool)
        yield rows[: k + 1, pushed[whole]], (running[popped] - running[pushed])[whole]


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 3, least: int = 10) -> DataFrame:
    """``lang``, ``size``, ``phrase`` and ``f`` of all phrases of 1 to ``max_n`` words that occur ``least`` times; size 0 has all words of the language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(SPREAD * partitions, -(-size // BUCKET))
    hot = spark.sparkContext.broadcast(_hot(rows, size, n, max_n))

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text", SLICE):
            names, words, rows, counts = suffixes(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), max_n)
            bucket = (routed(*hashes(names, words), rows, hot.value) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, rows, counts = bucket[order], rows[:, order], counts[order]
            for a, b in zip(starts := [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)], starts[1:], strict=False):
                known, own = np.unique(rows[1:, a:b], return_inverse=True)
                known, own = (known, own) if known[0] == 0 else (np.append(0, known), own + 1)
                own = np.concatenate([rows[:1, a:b], own.reshape(max_n, -1), counts[None, a:b]]).astype(np.int32)
                held = _BREAK.join(words.take(pa.array(known[1:] - 1)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([names], pa.list_(pa.string())), pa.array([pack(held)], pa.binary()), pa.array([pack(own.tobytes())], pa.binary())], names=["bucket", "langs", "words", "suffixes"])

    def count(group: pa.Table) -> pa.Table:
        unpack, texts, names, rows, at, to = zstandard.ZstdDecompressor().decompress, [], [], [], 0, 0
        for langs, held, own in zip(*(group.column(c).to_pylist() for c in ("langs", "words", "suffixes")), strict=True):
            own = np.frombuffer(unpack(own), np.int32).reshape(max_n + 2, -1).copy()
            own[0] += to
            own[1:-1] += np.where(own[1:-1] > 0, at, 0).astype(np.int32)
            texts.append(unpack(held))
            names += langs
            rows.append(own)
            at, to = at + texts[-1].count(_BREAK) + 1, to + len(langs)
        data = np.frombuffer(_BREAK.join(texts), np.uint8)
        words, number = ranked(binaries(data, data != _BREAK[0])[0])
        langs, of = ranked(pa.array(names, pa.string()))
        rows = np.concatenate(rows, axis=1)
        counts, rows = rows[-1].astype(np.int64), np.concatenate([of[rows[:1]], np.append(0, number + 1)[rows[1:-1]]]).astype(np.int32)
        lang, word = hashes(langs.to_pylist(), words)
        found = []
        for k, (prefixes, f) in enumerate(prefix_counts(rows, [len(langs), *[len(words) + 1] * max_n], counts)):
            part = np.ones(len(f), bool)
            if k:  # a prefix that is hot at each of its lengths is counted in several buckets
                h = lang[prefixes[0]]
                for column in prefixes[1:]:
                    h = joined(h, word[column])
                    part &= among(h, hot.value)
                part &= k < max_n
            kept = part | (f >= least)
            columns = [words.take(pa.array(c[kept] - 1)) for c in prefixes[1:]]
            phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if k else pa.array([b""] * int(kept.sum()), pa.binary())
            found.append(pa.table({"lang": langs.take(pa.array(prefixes[0][kept])), "size": pa.array(np.full(int(kept.sum()), k, np.int32)), "phrase": phrase.cast(pa.string()), "f": pa.array(f[kept]), "part": pa.array(part[kept])}))
        return pa.concat_tables(found)

    sent = rows.mapInArrow(send, "bucket int, langs array<string>, words binary, suffixes binary")
    found = sent.repartition(max(partitions, n // SPREAD), "bucket").groupBy("bucket").applyInArrow(count, "lang string, size int, phrase string, f long, part boolean")
    found = materialise(found)
    parts = found.where("part").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))
    return found.where(~F.col("part")).drop("part").unionByName(parts)


def _hot(rows: DataFrame, size: int, n: int, max_n: int) -> np.ndarray | None:
    """Hashes of the first words, and longer prefixes of these, that fill HOT of a bucket's mean in a sample, sorted; None for all.

    There are n / HOT at most of each length, whatever the texts.
    """
    if max_n < 2 or n > WIDEST:
        return np.zeros(0, np.uint64) if max_n < 2 else None

    def gather(batches):
        for batch in slices(batches, "text", SLICE):
            names, words, own, counts = suffixes(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), max_n - 1)
            lang, word = hashes(names, words)
            total = int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["h", "n"])
            for prefixes, f in list(prefix_counts(own, [len(names), *[len(words) + 1] * (max_n - 1)], counts))[1:]:
                h = reduce(joined, (word[c] for c in prefixes[1:]), lang[prefixes[0]])
                # what is much rarer in a slice adds little
                often = f * n >= HOT * total / 2
                yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(f[often])], names=["h", "n"])

    sample = rows if size <= SAMPLE else rows.sample(SAMPLE / size, seed=1)
    found = sample.mapInArrow(gather, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = found.where(F.col("h") == 0).agg(F.sum("n")).first()[0] or 0
    hot = found.where((F.col("h") != 0) & (F.col("n") * n >= HOT * total)).select("h").toArrow()["h"].to_numpy()
    return np.sort(hot.view(np.uint64))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_n`` words: lang, rank, phrase, a (its count), l, r (those of the parts at the lowest cut), n (all words) and score.

    A phrase within a longer one whose count is ``inside`` percent of its own or more is left out.
    """
    counts = materialise(phrase_counts(docs, text, lang, max_n, least))
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    found = counts.where(F.col("size") > 1).select("lang", "size", "phrase", F.col("f").alias("a"))
    # every phrase inside a longer one, and the longer one's count
    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    within = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(i, n))))
    longer = found.where(F.col("size") > 2).select("lang", F.explode(within).alias("phrase"), F.col("a").alias("of")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    stay = found.join(longer, ["lang", "phrase"], "left").where(F.col("of").isNull() | (100 * F.col("of") < inside * F.col("a"))).drop("of")
    # both parts at each cut; the counts of all of them at once
    cut = lambda k, side, key: F.struct((2 * k + side).alias("at"), F.struct(F.col("lang"), key.alias("phrase")).alias("key"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(cut(k, 0, part(1, k)), cut(k, 1, part(k + 1, F.col("size"))))))
    asked = materialise(stay.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.at", "cut.key"))
    times = asked.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    known = counts.select(F.struct("lang", "phrase").alias("key"), "f").join(times, "key")
    told = lookup(asked, materialise(known), "key", "times")
    of = told.groupBy("lang", "phrase", "a").agg(F.map_from_entries(F.collect_list(F.struct("at", "f"))).alias("f"))
    scored = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: _scored(F.col("a"), F.element_at("f", 2 * k), F.element_at("f", 2 * k + 1), k))
    best = of.select("lang", "phrase", "a", F.array_min(scored).alias("best")).select("lang", "phrase", "a", "best.*")
    order = (F.desc("score"), F.desc("a"), "phrase")
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    first = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(a, left, right, k):
    wide = lambda x: x.cast("decimal(16,0)")
    score = F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))
    return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))
