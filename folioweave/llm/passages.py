"""Word-level substring deduplication with difference-cover anchors.

A passage of 13 words goes from a document where an earlier one (by id) has it too. Windows of 7 words are hashed only at
places whose remainder by 7 is in the difference cover {0, 1, 3}: whatever two remainders a common passage starts at,
one of its first 7 places has a remainder of the cover in both documents, so the two share an aligned anchor. Blocks
ask which anchors several documents hold, extend these to all windows of 13 words around them, ask for which windows an
earlier document exists (by 64 and 32 bits of two hashes), and drop the words that such windows cover.

The key must be a number or null. Cases: a null or empty text has no words; with fewer than 13 nothing goes; rows that share an id don't take words from
each other; rows without an id come after all others and don't take words from each other; a text of any length is read
whole; an empty table gives no rows; columns ``n_words``, ``n_removed`` and ``kept`` are replaced, all others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioweave.llm import exchange
from folioweave.llm.common import texts_as_bytes
from folioweave.llm.exchange import Keys, distinct, mix

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1

_FACTORS = np.random.default_rng(1847).integers(1, 1 << 62, (3, WINDOW)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_removed", T.LongType(), False),
        T.StructField("kept", T.BinaryType(), False),
    ]
)


def window_hashes(words: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` words from each place on (0 near the end)."""
    out = np.zeros(len(words), np.uint64)
    n = len(words) - size + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += words[k : k + n] * factors[k]
        out[:n] = mix(total)
    return out


class Block:
    """Words of a block's documents, one after another."""

    def __init__(self, rows: pa.RecordBatch, key: str, text: str):
        self.words = [t.split() for t in texts_as_bytes(rows.column(text))]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        coded = pa.array([w for ws in self.words for w in ws], pa.binary()).dictionary_encode()
        # two hashes of each word that don't hang on each other: anchors and 64 bits of a window are made of the first, 32 of the second
        numbers = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)]), np.uint64).reshape(-1, 2)
        self.hashes, self.others = numbers[coded.indices.to_numpy()].T.copy() if len(coded) else np.zeros((2, 0), np.uint64)
        ids = rows.column(key).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.hashes)) - self.starts[self.owner]
        self.left = self.sizes[self.owner] - self.place
        self.ids = ids

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the anchors, the anchors' places, and their numbers among the keys."""
        cover = np.isin(np.arange(PERIOD), COVER)
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= ANCHOR) & (self.sizes[self.owner] >= WINDOW))
        keys, number = distinct(window_hashes(self.hashes, ANCHOR, _FACTORS[0])[at], self.owner[at])
        return keys, at, number

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, Keys, np.ndarray]:
        """Starts of the windows that hold a shared anchor, their distinct keys with the lowest id here, and their numbers among the keys."""
        _, at, number = self.anchors()
        marked = np.zeros(len(self.hashes) + 1, np.int64)
        here = at[shared[number]]
        np.add.at(marked, np.maximum(here - (PERIOD - 1), self.starts[self.owner[here]]), 1)
        np.add.at(marked, here + 1, -1)
        start = np.flatnonzero((np.cumsum(marked[:-1]) > 0) & (self.left >= WINDOW))
        a = window_hashes(self.hashes, WINDOW, _FACTORS[1])[start]
        b = (window_hashes(self.others, WINDOW, _FACTORS[2])[start] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        first = np.ones(len(order), bool)
        first[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        runs = np.flatnonzero(first)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(first) - 1
        ids = self.ids[self.owner[start]]
        least = np.minimum.reduceat(ids[order], runs) if len(runs) else ids
        return start, Keys(a[order][runs], b[order][runs], least), of

    def removed(self, shared: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Which words windows of earlier documents cover."""
        start, keys, of = self.windows(shared)
        gone = start[earlier[of] | (self.ids[self.owner[start]] > keys.v[of])]
        cover = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        return np.cumsum(cover[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the UTF-8 of the kept words, joined by one space each."""
    blocks = exchange.blocks(docs, text)
    even = exchange.even_splitters(blocks.buckets(blocks.size // 14))

    def anchors():
        return lambda rows, _: Keys(Block(rows, key, text).anchors()[0])

    def windows():
        return lambda rows, told: Block(rows, key, text).windows(told[0][0])[1]

    def keep():
        def run(rows, told):
            block = Block(rows, key, text)
            gone = block.removed(told[0][0], told[1][0])
            counts = np.bincount(block.owner[gone], minlength=len(block.sizes)).astype(np.int64)
            kept = []
            for words, s, n in zip(block.words, block.starts.tolist(), counts.tolist(), strict=True):
                kept.append(b" ".join(words if not n else [w for w, g in zip(words, gone[s : s + len(words)].tolist(), strict=True) if not g]))
            return [pa.array(block.sizes), pa.array(counts), pa.array(kept, pa.binary())]

        return run

    once = blocks.told(exchange.ask(blocks, anchors, even))
    twice = once.told(exchange.ask(once, windows, even, least=True))
    return exchange.finish(twice, docs.schema, FIELDS, keep)
