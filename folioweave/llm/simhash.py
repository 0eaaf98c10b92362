"""SimHash near-duplicates with a segment-popcount embedding.

A text's 64-bit fingerprint takes the majority of each bit over XXH64 (seed 42) of its shingles of 4 words. The
embedding of a fingerprint is the number of set bits in each of its 32 segments of 2 bits: the Manhattan distance of two
embeddings is a lower bound of the number of differing bits. The grid: the segments form 8 groups, and a cell fixes the
counts in 4 of them; a distance of at most 4 can change at most 4 groups, so two near fingerprints share one of the 70
kinds of cells. Within a cell the bound is tried first and then the exact number of differing bits.

A cell of more than MANY fingerprints is split, and no task ever holds it: of its near pairs, either one more group has
equal counts, which makes a finer cell for each group that isn't fixed yet; or all others differ, which leaves no
differing bits to the fixed groups (two at least are needed to keep a count), so their very bits make a cell. Finer cells
are split once more. What then still shares 6 groups of counts, or 4 or 5 groups of bits, in a cell of more than MANY is cut by bits:
those that aren't fixed yet make 5 pieces, of which two near fingerprints have one in common, again and again until
cells have MANY at most or LAST free bits, and thus 2 to the power of LAST fingerprints.

Only distinct fingerprints are joined; texts of one fingerprint are linked by it. A cell gives a spanning forest of its
links, not all pairs.

Cases: null, empty and blank texts have fingerprint zero; fewer than 4 words are one shingle; repeated rows are rows of
one component; a row without an id takes part, but never names a component (null if no row of it has an id); a text of
any length is read whole; an empty table gives no rows; the result has the key, the fingerprint and the component alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import lookup, map_texts, materialise, texts_as_bytes
from folioweave.llm.components import components
from folioweave.llm.exchange import mix

WORDS, SEED, NEAR = 4, 42, 4
GROUPS = 8
#: In place of a group's number: the cell fixes bits.
BITS = 7
#: Cells of up to so many fingerprints are compared pair by pair at once, many cells together.
FEW = 8
#: Cells of more fingerprints are split, LEVELS times.
MANY, LEVELS = 512, 2
#: Free bits with which a cell is compared however many fingerprints it has.
LAST = 12

_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def fingerprint(text: bytes) -> int:
    """Unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    ends, h = ends[-n:], xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        hashes = [h(line[a:b], SEED) for a, b in zip(starts[k : min(k + 4096, n)].tolist(), ends[k : k + 4096].tolist(), strict=True)]
        counts += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    def make():
        return lambda batch: [pa.array(np.array([fingerprint(t) for t in texts_as_bytes(batch.column(text))], np.uint64).view(np.int64))]

    return map_texts(docs, text, T.StructType([T.StructField(into, T.LongType(), False)]), make)


ALL = np.uint64((1 << 64) - 1)
_PICKS = list(combinations(range(GROUPS), GROUPS - NEAR))
_ODD_BITS = np.uint64(0x5555555555555555)
#: Sums of the differences of the four counts in two bytes.
_APART = np.array([[sum(abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.uint8)


def embed(prints: np.ndarray) -> np.ndarray:
    """Counts of set bits in the 32 segments, in 2 bits each."""
    return prints - (prints >> np.uint64(1) & _ODD_BITS)


def cells(prints: np.ndarray) -> np.ndarray:
    """The 70 cells of each fingerprint, as (fingerprints, 70) longs."""
    groups = embed(prints).view(np.uint8).reshape(-1, GROUPS).astype(np.int64)
    return np.stack([(k << 32) | (groups[:, a] << 24) | (groups[:, b] << 16) | (groups[:, c] << 8) | groups[:, d] for k, (a, b, c, d) in enumerate(_PICKS)], axis=1)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs differ in at most NEAR bits; the embeddings' distance is tried first."""
    close = _APART[embed(a).view(np.uint8).reshape(-1, 8), embed(b).view(np.uint8).reshape(-1, 8)].sum(axis=1) <= NEAR
    close[close] = np.bitwise_count(a[close] ^ b[close]) <= NEAR
    return close


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (smallest fingerprint of the component, other) of the components that a cell's fingerprints form.

    Each fingerprint in turn is compared with those of other components only, so a group of near copies is done after a
    few of them.
    """
    prints = np.unique(prints)
    label = np.arange(len(prints))
    for k in range(len(prints)):
        other = np.flatnonzero(label != label[k])
        if not len(other):
            break
        met = np.unique(label[other[near(np.broadcast_to(prints[k], len(other)).copy(), prints[other])]])
        if len(met):
            label[np.isin(label, np.append(met, label[k]))] = min(met.min(), label[k])
    return [(int(prints[r]), int(prints[k])) for k, r in enumerate(label.tolist()) if r != k]


def finer(cell: np.ndarray, prints: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that a cell's fingerprints fall to when it is split: cells, fingerprints, and the bits that a cell leaves free.

    A cell's number is that of the cell before, one of the groups that weren't fixed (or BITS) and this group's counts;
    a cell of bits has the numbers of its groups and their bits before it.
    """
    counts, raw = embed(prints).view(np.uint8).reshape(-1, GROUPS).astype(np.int64), prints.view(np.uint8).reshape(-1, GROUPS).astype(np.int64)
    made, of, free = [], [], []
    chain = [cell >> (11 * up) for up in range(level, -1, -1)]  # this cell's ancestors, the coarsest first
    names = np.stack([chain[0] >> 32, *((c >> 8) & 7 for c in chain[1:])], axis=1)
    for name in np.unique(names, axis=0).tolist():
        at = np.flatnonzero((names == name).all(axis=1))
        if BITS in name[1:]:
            continue
        fixed = list(_PICKS[name[0]])
        for j in name[1:]:
            fixed.append([g for g in range(GROUPS) if g not in fixed][j])
        rest = [g for g in range(GROUPS) if g not in fixed]
        for j, g in enumerate(rest):
            made.append((cell[at] << 11) | (j << 8) | counts[at, g])
            of.append(prints[at])
            free.append(np.full(len(at), ALL, np.uint64))
        bits = np.full(len(at), name[0], np.int64)
        for j in name[1:]:
            bits = (bits << 3) | j
        for g in fixed:
            bits = (bits << 8) | raw[at, g]
        made.append((bits << 11) | (BITS << 8))
        of.append(prints[at])
        free.append(np.full(len(at), sum(255 << 8 * g for g in rest), np.uint64))
    return np.concatenate(made or [np.zeros(0, np.int64)]), np.concatenate(of or [np.zeros(0, np.uint64)]), np.concatenate(free or [np.zeros(0, np.uint64)])


def pieces(free: int) -> list[int]:
    """Free bits cut into one more piece than NEAR."""
    places = [k for k in range(64) if free >> k & 1]
    return [sum(1 << k for k in part) for part in np.array_split(np.array(places, object), NEAR + 1)]


def cut(cell: np.ndarray, prints: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a cell's fingerprints by each piece of their free bits, the fingerprints, and the bits still free."""
    made, of, left = [], [], []
    for mask in np.unique(free).tolist():
        at = np.flatnonzero(free == mask)
        for k, piece in enumerate(pieces(mask)):
            h = mix(cell[at].view(np.uint64) + np.uint64(k + 1)) ^ mix(prints[at] & np.uint64(piece))
            made.append(mix(h).view(np.int64))
            of.append(prints[at])
            left.append(np.full(len(at), mask & ~piece, np.uint64))
    return np.concatenate(made), np.concatenate(of), np.concatenate(left)


def links(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Links ``a`` and ``b`` that connect all near ones of distinct fingerprints (signed longs)."""

    def spread(batches):
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(found), 8192):
                part = found[a : a + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(cells(part).ravel()), pa.array(np.repeat(part, len(_PICKS)).view(np.int64))], names=["cell", "print"])

    found, rest, rows = [], [], prints.select(column).distinct().mapInArrow(spread, "cell long, print long")
    linked = lambda made: made.where("cell is null").select("a", "b")
    for level in range(LEVELS + 1):
        made = materialise(_joined(rows, level))
        found.append(linked(made))
        rest.append(made.where("cell is not null and b is not null"))
        rows = made.where("cell is not null and b is null").select("cell", F.col("a").alias("print"))
        if rows.isEmpty():
            break
        rows = _split(rows, level)
    left = reduce(DataFrame.unionByName, rest)
    while not left.isEmpty():
        made = materialise(_joined(_cut(left.select("cell", F.col("a").alias("print"), F.col("b").alias("free"))), LEVELS))
        found.append(linked(made))
        left = made.where("cell is not null")
    return reduce(DataFrame.unionByName, found).distinct()


def _joined(rows: DataFrame, level: int) -> DataFrame:
    """Links ``a``, ``b`` within cells, and the fingerprints ``a`` of the cells (``cell``) that are to be split; ``b`` has their free bits if by bits."""

    def join(batches):
        none = np.zeros(0, np.uint64)
        held = (np.zeros(0, np.int64), none, none)
        large = None  # the cell whose rows go on as they come
        for batch in batches:
            cell = np.concatenate([held[0], batch.column(0).to_numpy()])
            found = np.concatenate([held[1], batch.column(1).to_numpy().view(np.uint64)])
            own = batch.column(2).to_numpy().view(np.uint64) if batch.num_columns > 2 else np.full(batch.num_rows, ALL, np.uint64)
            free = np.concatenate([held[2], own])
            starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
            sizes = np.diff(np.append(starts, len(cell)))
            many = (sizes > MANY) | (cell[starts] == large)
            splits = many & (level < LEVELS) & (((cell[starts] >> 8) & 7 != BITS) | (level == 0))
            by_bits = many & ~splits & (np.bitwise_count(free[starts]) > LAST)
            later, last_cells = np.repeat(splits, sizes), splits | by_bits
            bits = np.repeat(by_bits, sizes)
            last = len(cell) if last_cells[-1:].any() else int(starts[-1]) if len(starts) else 0  # the last cell may go on in the next batch
            yield _rows(cell[later], found[later], None)
            yield _rows(cell[bits], found[bits], free[bits])
            now = ~(later | bits)[:last]
            yield _linked(cell[:last][now], found[:last][now])
            large = int(cell[-1]) if last_cells[-1:].any() else None
            held = cell[last:], found[last:], free[last:]
        yield _linked(*held[:2])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "cell long, a long, b long")


def _split(rows: DataFrame, level: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            cell, prints, free = finer(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), level)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(prints.view(np.int64)), pa.array(free.view(np.int64))], names=["cell", "print", "free"])

    return rows.mapInArrow(run, "cell long, print long, free long")


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, prints, free = cut(batch.column(0).to_numpy(), *(batch.column(k).to_numpy().view(np.uint64) for k in (1, 2)))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(prints.view(np.int64)), pa.array(free.view(np.int64))], names=["cell", "print", "free"])

    return rows.mapInArrow(run, "cell long, print long, free long")


def _rows(cell: np.ndarray, prints: np.ndarray, free: np.ndarray | None) -> pa.RecordBatch:
    bits = pa.nulls(len(cell), pa.int64()) if free is None else pa.array(free.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(prints.view(np.int64)), bits], names=["cell", "a", "b"])


def _linked(cell: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Links within the cells of sorted rows."""
    starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1)) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(cell)))
    made: set[tuple[int, int]] = set()
    for s, z in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        made.update(forest(found[s : s + z]))
    size_at = np.repeat(sizes, sizes)
    for d in range(1, FEW):
        at = np.flatnonzero((cell[d:] == cell[:-d]) & (size_at[d:] <= FEW))
        if not len(at):
            break
        a, b = found[at], found[at + d]
        ok = near(a, b)
        made.update(zip(np.minimum(a, b)[ok].tolist(), np.maximum(a, b)[ok].tolist(), strict=True))
    pairs = np.array(sorted(made), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["cell", "a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of each row of ``docs`` with ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    rows = materialise(fingerprints(docs.select(key, text)).select(key, "fingerprint"))
    classes = materialise(rows.groupBy("fingerprint").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_times")))
    labels = components(links(classes))
    joined = classes.join(labels, classes["fingerprint"] == labels["node"])
    least = joined.groupBy("root").agg(F.min("_first").alias("_least"))
    linked = labels.join(least, "root").select(F.col("node").alias("_node"), "_least")
    found = classes.join(linked, classes["fingerprint"] == linked["_node"], "left")
    found = materialise(found.select("fingerprint", F.coalesce("_least", "_first").alias("component_id"), "_times"))
    out = lookup(rows, found, "fingerprint", "_times")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
