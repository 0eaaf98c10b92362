"""Byte-level substring deduplication: which 200-byte strings occur at two places or more.

The suffixes in question are sorted by splitters and buckets as a suffix array is built: sampled splitters
range-partition them by their leading 6 bytes, buckets order them by these and ties by a hash, and neighbours are
compared; beyond byte 6 the order isn't that of the bytes, but equal suffixes are neighbours.
Three things keep this within the size of the input. Suffixes take part with their first 6 bytes and hashes of
their first 200, which is as far as any comparison has to go. Of suffixes that can't be repeated none takes part, of
those in the midst of a longer repeat neither: both are told by anchors. The anchor of a 200-byte string is the last of
its 101 places whose 100 bytes have the least hash, so equal strings have it at the same offset. Anchors are compared
first, by their 100 bytes and by the context of all strings that they are the anchors of. A repeated context settles its
own strings; an anchor of one context only rules all others out; where contexts differ, the strings of each context are
sorted as suffixes, of a repeated one those of one place. And equal suffixes of a block go as one, so
splitters cut between unequal ones only and no run of equal ones goes over a boundary.

Equality rests on two polynomial hashes that are independent of each other, one modulo 2 ** 64 and one modulo the prime
2 ** 61 - 1. Contexts are told apart by 64 bits of the first (of their anchor) and the second, suffixes by their 6
bytes, 16 bits of the first and the second. Two strings of at most 301 bytes have the same second one at no more
than 301 of its 2 ** 61 bases.

Cases: a null or empty text has no bytes, and from a text under 200 bytes nothing goes; repeated rows are places like any
others; a removed run may cut a character, so what is kept is bytes; a text of any length is read whole; an empty table
gives no rows; columns ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` are replaced, all others are kept.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm import exchange
from folioweave.llm.common import materialise, texts_as_bytes
from folioweave.llm.exchange import ONE, Keys, mix

LENGTH, GRAM = 200, 100
SPREAD = LENGTH - GRAM + 1
#: Blocks that splitters are sampled from, suffixes of each, and suffixes for each bucket at least.
SAMPLED, EACH, CUT = 48, 512, 32

_RANDOM = np.random.default_rng(9001).integers(1, 1 << 62, 257).astype(np.uint64) * np.uint64(2) + ONE
_BYTE, _BASE = _RANDOM[:256], int(_RANDOM[256])
PRIME, _HALF = np.uint64((1 << 61) - 1), np.uint64(31)
_LOW = np.uint64((1 << 31) - 1)
_ROOT = int(np.random.default_rng(6101).integers(1 << 40, int(PRIME)))
#: So many bytes' products of two halves can be added up in 64 bits.
_ADDED = 1 << 22
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP = np.uint64(1 << 63)

FIELDS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType(), False),
        T.StructField("n_removed", T.LongType(), False),
        T.StructField("n_spans", T.LongType(), False),
        T.StructField("kept", T.BinaryType(), False),
    ]
)


def folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of numbers below it, by halves of 31 and 30 bits."""
    a_high, a_low, b_high, b_low = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = a_high * b_low + a_low * b_high
    thirty = np.uint64(30)
    return folded(a_high * b_high * np.uint64(2) + (middle >> thirty) + ((middle & np.uint64((1 << 30) - 1)) << _HALF) + folded(a_low * b_low))


def powers_of(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), int(PRIME))))])
    return out[:n]


class Powers:
    """Powers of the bases and of their inverses, as many as were asked for; one in a task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.low = self.high = np.zeros(0, np.uint32)
        inverse = pow(_ROOT, -1, int(PRIME))
        self.small, self.great = powers_of(inverse, 4096), powers_of(pow(inverse, 4096, int(PRIME)), 4096)

    def halves(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Low and high bits of the powers modulo the prime."""
        if len(self.low) < n:
            found = powers_of(_ROOT, 1 << (n - 1).bit_length())
            self.low, self.high = (found & _LOW).astype(np.uint32), (found >> _HALF).astype(np.uint32)
        return self.low[:n], self.high[:n]

    def inverse(self, at: np.ndarray) -> np.ndarray:
        """Powers of the inverse modulo the prime."""
        high = at >> 12
        if len(high) and int(high.max()) >= len(self.great):
            self.great = powers_of(pow(_ROOT, -4096, int(PRIME)), int(high.max()) + 1)
        return times(self.small[at & 4095], self.great[high])

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.append(ONE, np.full(size - 1, x, np.uint64))) for x in (_BASE, inverse))
        return self.up[:n], self.down[:n]


def sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``size`` neighbours."""
    have, out = 1, x
    while have * 2 <= size:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (size - have)], out[size - have :]) if have < size else out


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Distinct pairs in order, the lowest bit of ``b`` given over to whether several places hold one, and each place's number among them."""
    b = b >> ONE
    order = exchange.multikey_order(a, b)
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    runs = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    times = np.diff(np.append(runs, len(order)))
    return Keys(a[order][runs], (b[order][runs] << ONE) | (times > 1).astype(np.uint64)), of


class Block:
    """Bytes of a block's texts of at least LENGTH bytes, one after another, and their hashes."""

    def __init__(self, texts: list[bytes], powers: Powers):
        self.texts = texts
        self.sizes = np.array([len(t) if len(t) >= LENGTH else 0 for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join([t for t in texts if len(t) >= LENGTH]), np.uint8)
        up, self.down = powers.upto(len(self.data) + 1)
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=self.prefix[1:])
        self.powers = powers

    @cached_property
    def sums(self) -> tuple[np.ndarray, ...]:
        """What hashes modulo the prime are made of; not there while anchors are chosen, which takes the most memory."""
        return tuple(self._sums(x) for x in self.powers.halves(len(self.data)))

    def _sums(self, half: np.ndarray) -> np.ndarray:
        """Sums of the bytes' products with halves of powers, brought below the prime now and then."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        for a in range(0, len(self.data), _ADDED):
            b = min(a + _ADDED, len(self.data))
            np.cumsum((self.data[a:b].astype(np.uint64) + ONE) * half[a:b], out=out[a + 1 : b + 1])
            out[a + 1 : b + 1] += folded(out[a : a + 1])
        return out

    def prime_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (folded(x[end]) + PRIME - folded(x[start]) for x in self.sums)
        return times(folded(folded(low) + times(folded(high), np.uint64(1 << 31))), self.powers.inverse(start))

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the strings of LENGTH bytes: places, and the first and last start of the strings that have each."""
        n = len(self.data)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 3
        x = np.full(n, _NONE)
        m = n - GRAM + 1
        x[:m] = mix(self.hashes(slice(0, m), slice(GRAM, n + 1)))
        strings = np.ones(n, bool)
        for e in np.unique(self.ends).tolist():
            x[max(0, e - GRAM + 1) : e] = _NONE
            strings[max(0, e - LENGTH + 1) : e] = False
        least = np.zeros(n + SPREAD - 1, np.uint64)
        least[SPREAD - 1 : n] = sliding(x, SPREAD, np.minimum)
        chosen = (sliding(least, SPREAD, np.maximum) == x) & (x != _NONE)
        at, upto, least = np.flatnonzero(chosen), np.cumsum(chosen, dtype=np.int32), least[SPREAD - 1 :]
        hashes = x[at]

        def anchor(start: np.ndarray) -> np.ndarray:
            """From the last place chosen in a string back to the last one of its least hash."""
            of, wanted = upto[start + SPREAD - 1] - 1, least[start]
            late = np.flatnonzero(hashes[of] != wanted)
            while len(late):
                of[late] -= 1
                late = late[hashes[of[late]] != wanted[late]]
            return of

        # strings in a row with one least hash have one anchor, unless its bytes are there again nearby
        new = strings.copy()
        new[1:] &= ~strings[:-1] | (least[1:n] != least[: n - 1])
        first = np.flatnonzero(new)
        if not len(first):
            return (np.zeros(0, np.int64),) * 3
        size = np.add.reduceat(strings, first, dtype=np.int64)
        last = first + size - 1
        of = anchor(first)
        torn = np.flatnonzero(anchor(last) != of)
        if len(torn):
            start = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[torn].tolist(), last[torn].tolist(), strict=True)])
            own = anchor(start)
            cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(start, prepend=-1) != 1))
            whole = np.ones(len(first), bool)
            whole[torn] = False
            of = np.concatenate([of[whole], own[cut]])
            first, last = np.concatenate([first[whole], start[cut]]), np.concatenate([last[whole], start[np.append(cut[1:], len(start)) - 1]])
        return at[of], first, last

    def contexts(self) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys (an anchor's bytes, its context: all bytes of its strings), the anchors' numbers among them, and first and last start of each anchor's strings."""
        at, first, last = self.anchors()
        shape = ((at - first) * LENGTH + (last - first)).astype(np.uint64)
        # not the hashes that anchors were chosen for being the least of: those would all go to the first buckets
        gram, context = mix(self.hashes(at, at + GRAM) + ONE), (self.prime_hashes(first, last + LENGTH) ^ shape << np.uint64(45)) << ONE
        keys, number = distinct_pairs(gram, context)
        return keys, number, first, last

    def suffixes(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, Keys, np.ndarray]:
        """Whether each place starts a string that is repeated for sure; the starts in question, their keys, and their numbers among these."""
        _, number, first, last = self.contexts()
        shared, speaks, mixed = told[:, number]
        repeated = self.spread(first, last, shared)
        # where an anchor's contexts differ: strings of a context that only this place has, and those of other contexts
        # at one place of the corpus
        once = np.zeros(len(number), bool)
        once[np.unique(number, return_index=True)[1]] = True
        asked = np.flatnonzero(self.spread(first, last, mixed & (~shared | (speaks & once))))
        lead = np.zeros(len(asked), np.uint64)
        for k in range(6):
            lead = (lead << np.uint64(8)) | self.data[asked + k]
        lead = (lead << np.uint64(16)) | (mix(self.hashes(asked, asked + LENGTH)) >> np.uint64(48))
        keys, of = distinct_pairs(lead, self.prime_hashes(asked, asked + LENGTH) << ONE)
        return repeated, asked, keys, of

    def spread(self, first: np.ndarray, last: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Places from ``first`` to ``last`` of those that are meant."""
        marks = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(marks, first[which], 1)
        np.add.at(marks, last[which] + 1, -1)
        return np.cumsum(marks[:-1]) > 0

    def removed(self, told: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Which bytes are covered by repeated strings."""
        repeated, asked, _, of = self.suffixes(told)
        repeated[asked] |= shared[of]
        at = np.flatnonzero(repeated)
        return self.spread(at, at + LENGTH - 1, np.ones(len(at), bool))

    def kept(self, gone: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
        """Of each text: removed bytes, removed runs, and what is kept."""
        removed, spans, kept = [], [], []
        for t, s, n in zip(self.texts, self.starts.tolist(), self.sizes.tolist(), strict=True):
            mask = gone[s : s + n]
            removed.append(int(mask.sum()))
            spans.append(int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()))
            kept.append(t if not removed[-1] else self.data[s : s + n][~mask].tobytes())
        return removed, spans, kept


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the bytes left."""
    blocks = exchange.blocks(docs, text)

    def anchors():
        powers = Powers()
        return lambda rows, _: Block(texts_as_bytes(rows.column(text)), powers).contexts()[0]

    def suffixes():
        powers = Powers()
        return lambda rows, told: Block(texts_as_bytes(rows.column(text)), powers).suffixes(told[0])[2]

    def keep():
        powers = Powers()

        def run(rows, told):
            block = Block(texts_as_bytes(rows.column(text)), powers)
            removed, spans, kept = block.kept(block.removed(told[0], told[1][0]))
            return [pa.array([len(t) for t in block.texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]

        return run

    first = exchange.ask(blocks, anchors, exchange.even_splitters(blocks.buckets(blocks.size // (SPREAD // 4))))
    once = blocks.told(first)
    twice = once.told(exchange.ask(once, suffixes, splitters(once, suffixes)))
    return exchange.finish(twice, docs.schema, FIELDS, keep)


def splitters(blocks: exchange.Blocks, make) -> np.ndarray:
    """Cuts (leading bytes, hash) for buckets of suffixes, from CUT suffixes or more for each bucket.

    About SAMPLED blocks say how many suffixes there are. If they have too few for as many buckets as that makes, more
    blocks are sampled, and the cuts are found where their suffixes lie: the driver gets the cuts alone.
    """
    n_blocks = blocks.size / exchange.BLOCK + 1
    share = min(1.0, max(SAMPLED, 4 * blocks.unit) / n_blocks)
    rows = _sampled(blocks, make, share).collect()
    total = sum(r[0] for r in rows) / max(1, len(rows)) * n_blocks
    n = blocks.buckets(int(total))
    parts = [(np.frombuffer(r[1], np.uint64), np.frombuffer(r[2], np.uint64) & ~ONE, np.full(len(r[1]) // 8, r[0] / max(1, len(r[1]) // 8))) for r in rows]
    if not parts or not total or n == 1:
        return np.zeros((0, 2), np.uint64)
    a, b, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
    if len(a) < CUT * n and share < 1:
        cuts = _cuts(_sampled(blocks, make, min(1.0, share * 1.2 * CUT * n / len(a))), n)
    else:
        order = exchange.multikey_order(a, b)
        at = np.searchsorted(np.cumsum(weight[order]), np.arange(1, n) * weight.sum() / n)
        cuts = np.stack([a[order][at], b[order][at]], axis=1)
    return cuts[np.append(True, (cuts[1:] != cuts[:-1]).any(axis=1))] if len(cuts) else cuts


def _sampled(blocks: exchange.Blocks, make, share: float) -> DataFrame:
    """How many suffixes each of a share of all blocks has, and EACH of them in steps."""
    replies = blocks.replies()

    def sample(batches):
        fn = make()
        for batch in batches:
            for k in range(batch.num_rows):
                for held, told in exchange.each_block(batch, replies, k):
                    keys = fn(held, told)
                    at = np.unique(np.linspace(0, len(keys.a) - 1, EACH).astype(np.int64)) if len(keys.a) else np.zeros(0, np.int64)
                    row = [pa.array([len(keys.a)], pa.int64()), *(pa.array([c[at].tobytes()], pa.binary()) for c in (keys.a, keys.b))]
                    yield pa.RecordBatch.from_arrays(row, names=["n", "a", "b"])

    return blocks.frame.sample(share, seed=1).mapInArrow(sample, "n long, a binary, b binary")


def _cuts(sampled: DataFrame, n: int) -> np.ndarray:
    """The suffixes at which a further n-th of all begins, by prefix sums of the sampled ones' weights over ranges."""

    def opened(batches):
        for batch in batches:
            for size, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "a", "b")), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64) & ~ONE
                # a signed long with the first bit turned over is in the order of the unsigned one
                signed = [pa.array((x ^ _TOP).view(np.int64)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*signed, pa.array(np.full(len(a), size / max(1, len(a))))], names=["a", "b", "w"])

    rows = sampled.mapInArrow(opened, "a long, b long, w double")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.repartitionByRange(ranges, "a", "b").sortWithinPartitions("a", "b").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    # one row for each range
    sums = rows.groupBy("range").agg(F.sum("w").alias("w"))
    total = sums.agg(F.sum("w")).first()[0]
    before = sums.select("range", F.coalesce(F.sum("w").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    so_far = F.sum("w").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).join(before, "range").withColumn("so_far", F.col("so_far") + F.col("before"))
    part = lambda x: F.floor(x * n / total)
    found = rows.where((part(F.col("so_far")) > part(F.col("so_far") - F.col("w"))) & (part(F.col("so_far")) < n)).orderBy("at").select("a", "b").toArrow()
    return np.stack([found[c].to_numpy().view(np.uint64) ^ _TOP for c in ("a", "b")], axis=1) if found.num_rows else np.zeros((0, 2), np.uint64)
