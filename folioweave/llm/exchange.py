"""Questions that blocks of documents ask about keys of the whole corpus.

Documents are packed into blocks of a few MB, blocks into units. A block asks about its distinct keys: sorted, cut at
splitters and sent to buckets, one message from each unit with its blocks' keys in a row. A bucket sorts what all units
sent and answers each with one bit a key, in the order sent, so answers are tiny and a key that a third of all documents
hold is one item from each block. Units keep their partitioning and answers come with the same one, so nothing but keys
and answers moves.

Partitions, units and buckets follow the size of the texts. Up to some 50 GB a unit is one block and a bucket has
KEYS keys. Messages would shrink as buckets multiply, so beyond that units and buckets both grow, to hold a message at
about MESSAGE keys; a block is still worked on by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import checkpointed, slices

#: Bytes of text in a block, blocks in a partition, and keys for which a bucket is made.
BLOCK, BLOCKS, KEYS = 3 << 20, 4, 1 << 19
#: Keys that a message should have, and how many times KEYS a bucket may have for that.
MESSAGE, WIDEST = 32, 16

ONE = np.uint64(1)


class Keys:
    """Distinct keys of a block, in order: ``a`` (64 bits), ``b`` (64 or 32 bits, or none) and ``v`` (a signed long, or none)."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None = None, v: np.ndarray | None = None):
        self.a, self.b, self.v = a, b, v

    def cuts(self, splitters: np.ndarray) -> np.ndarray:
        """Where the keys of each bucket begin; splitters are (a, b) rows, or a alone."""
        if splitters.ndim == 1:
            return np.searchsorted(self.a, splitters)
        low, high = np.searchsorted(self.a, splitters[:, 0]), np.searchsorted(self.a, splitters[:, 0], "right")
        return np.array([x + np.searchsorted(self.b[x:y], s) for x, y, s in zip(low, high, splitters[:, 1], strict=True)], np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def even_splitters(n: int) -> np.ndarray:
    """Cuts of evenly spread 64-bit keys into ``n`` buckets."""
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def distinct(keys: np.ndarray, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, their lowest bit given over to whether several owners (or places) hold one, and each place's number among them.

    ``owners`` ascend.
    """
    keys = keys >> ONE
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.diff(ranked, prepend=ranked[:1] ^ ONE) != 0 if len(ranked) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(ranked))[: len(starts)]
    several = owners[order[ends - 1]] != owners[order[starts]] if owners is not None else ends - starts > 1
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(first) - 1
    return (ranked[starts] << ONE) | several.astype(np.uint64), number


@dataclass(frozen=True)
class Blocks:
    """Units of blocks (``blk``; ``payload``: each block as an Arrow stream; answers so far), partitioned by ``blk``."""

    frame: DataFrame
    parts: int
    #: bytes of all texts, blocks in a unit, keys in a bucket
    size: int
    unit: int
    keys: int

    def buckets(self, n_keys: int) -> int:
        return max(1, -(-n_keys // self.keys))

    def told(self, answers: DataFrame) -> Blocks:
        """The blocks with their answers in one more column."""
        n = len(self.replies())
        answers = answers.hint("shuffle_hash").select(F.col("blk").alias("_blk"), F.col("answers").alias(f"answers{n}"))
        return replace(self, frame=self.frame.join(answers, F.col("blk") == F.col("_blk"), "left").drop("_blk"))

    def replies(self) -> list[str]:
        return [c for c in self.frame.columns if c.startswith("answers")]


def _partitioned(df: DataFrame) -> DataFrame:
    """``df`` checkpointed with its partitioning, which spares later joins a shuffle; an adaptive plan would lose it.

    The setting is another one for no longer than the plan takes to make, and for one plan at a time.
    """
    spark = df.sparkSession
    with SparkContext._lock:
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df._jdf.queryExecution().executedPlan()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return checkpointed(df)


def grown(size: int) -> tuple[int, int]:
    """Blocks in a unit and keys in a bucket for so many bytes of text."""
    times = max(1, MESSAGE * size // (BLOCK * KEYS))
    wider = min(WIDEST, isqrt(times))
    return -(-times // wider), KEYS * wider


def blocks(docs: DataFrame, text: str) -> Blocks:
    """``docs`` as blocks."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    unit, keys = grown(size)
    names = docs.columns

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        number, streams, held, held_bytes = TaskContext.get().partitionId() << 32, [], [], 0

        def stream():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
                for x in held:
                    writer.write_batch(x)
            return sink.getvalue().to_pybytes()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([streams], pa.list_(pa.binary()))], names=["blk", "payload"])

        for part in slices(batches, text, BLOCK):
            part_bytes = part.column(names.index(text)).nbytes
            if held and held_bytes + part_bytes > BLOCK:
                streams.append(stream())
                held, held_bytes = [], 0
                if len(streams) == unit:
                    yield out()
                    number, streams = number + 1, []
            held.append(part)
            held_bytes += part_bytes
        if held:
            streams.append(stream())
            yield out()

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (BLOCK * max(BLOCKS, unit))))
    frame = _partitioned(docs.mapInArrow(run, "blk long, payload array<binary>").repartition(parts, "blk"))
    return Blocks(frame, parts, size, unit, keys)


def opened(payload: bytes) -> pa.RecordBatch:
    """A block's rows."""
    found = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return found.to_batches()[0]


def each_block(batch: pa.RecordBatch, replies: list[str], k: int):
    """The rows of each block of unit ``k`` and the answers that it has."""
    payload = batch.column("payload")[k]
    answers = [bits_of(batch.column(c)[k].as_py(), len(payload)) for c in replies]
    for j, stream in enumerate(payload):
        yield opened(stream.as_py()), [x[j] for x in answers]


def slots(n: int) -> np.ndarray:
    """For each of ``n`` partitions a number that Spark's hash (Murmur3 of an int, seed 42) deals to it, so that none gets two.

    What isn't found, which is unlikely, shares another's partition.
    """
    tries = np.arange(int(n * (np.log(n) + 10)), dtype=np.uint32)
    turned = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    h = turned(turned(tries * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
    out = -1 - np.arange(n)
    found, first = np.unique(part, return_index=True)
    out[found] = tries[first]
    return out.astype(np.int32)


def ask(blocks: Blocks, make: Callable, splitters: np.ndarray, least: bool = False) -> DataFrame:
    """Answers to the keys that ``make()(rows, answers so far)`` finds in each block: ``blk`` and one array of buckets' bits.

    The answer is whether several blocks hold a key, or one whose lowest bit (of the last of ``a`` and ``b``) is set. If
    keys have a ``b``, two more bits tell if this block is the one of those that hold the key that may speak for it, and
    if several ``b`` are held for its ``a``. With ``least``, the answer is whether a lower ``v`` is held for the key.
    """
    sent = blocks.frame.sparkSession.sparkContext.broadcast((splitters, slots(len(splitters) + 1)))
    replies = blocks.replies()

    def send(batches):
        fn, (splitters, slot) = make(), sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                keys = [fn(rows, told) for rows, told in each_block(batch, replies, k)]
                edges = np.array([[0, *x.cuts(splitters).tolist(), len(x.a)] for x in keys])
                sizes = np.diff(edges, axis=1)
                spans = np.flatnonzero(sizes.any(axis=0)).tolist()
                blk = batch.column("blk")[k].as_py()
                parts = [[None if getattr(keys[0], c) is None else b"".join([getattr(x, c)[e[p] : e[p + 1]].tobytes() for x, e in zip(keys, edges, strict=True)]) for p in spans] for c in "abv"]
                columns = [pa.array(slot[spans], pa.int32()), pa.array(spans, pa.int32()), pa.array([blk] * len(spans), pa.int64()), pa.array(sizes.T[spans].tolist(), pa.list_(pa.int32())), *(pa.array(c, pa.binary()) for c in parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "bucket", "blk", "sizes", "a", "b", "v"])

    def answer(group: pa.Table) -> pa.Table:
        a = [np.frombuffer(x, np.uint64) for x in group.column("a").to_pylist()]
        sizes = [len(x) for x in a]
        a = np.concatenate(a)
        b, v = (group.column(c).to_pylist() for c in "bv")
        b = np.concatenate([np.frombuffer(x, np.uint64 if len(x) == 8 * n else np.uint32) for x, n in zip(b, sizes, strict=True)]) if b[0] is not None else None
        v = np.concatenate([np.frombuffer(x, np.int64) for x in v]) if v[0] is not None else None
        bits = answers(a, b, v, least)
        ends = np.cumsum(sizes)
        out = [np.packbits(bits[:, e - n : e].ravel()).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]
        kinds = pa.array([len(bits)] * len(sizes), pa.int32())
        return pa.table({"blk": group.column("blk"), "bucket": group.column("bucket"), "kinds": kinds, "sizes": group.column("sizes"), "bits": pa.array(out, pa.binary())})

    asked = blocks.frame.mapInArrow(send, "slot int, bucket int, blk long, sizes array<int>, a binary, b binary, v binary")
    answered = asked.repartition(len(splitters) + 1, "slot").groupBy("slot").applyInArrow(answer, "blk long, bucket int, kinds int, sizes array<int>, bits binary")
    answered = answered.repartition(blocks.parts, "blk")
    return _partitioned(answered.groupBy("blk").agg(F.collect_list(F.struct("bucket", "kinds", "sizes", "bits")).alias("answers")))


def multikey_order(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Order by ``a``; only runs of equal ``a`` are then ordered by ``b``."""
    order = np.argsort(a)
    if b is None or not len(a):
        return order
    ranked = a[order]
    same = np.zeros(len(a), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    tied = same.copy()
    tied[:-1] |= same[1:]
    at = np.flatnonzero(tied)
    run = np.cumsum(~same)[at]
    order[at] = order[at][np.lexsort((b[order[at]], run))]
    return order


def answers(a: np.ndarray, b: np.ndarray | None, v: np.ndarray | None, least: bool) -> np.ndarray:
    """A row of bits for each kind of answer."""
    flagged = None
    if not least:
        last = a if b is None else b
        flagged = last & last.dtype.type(1)
        a, b = (a >> ONE, b) if b is None else (a, b >> b.dtype.type(1))
    order = multikey_order(a, b)
    first = np.ones(len(a), bool)
    first[1:] = a[order[1:]] != a[order[:-1]]
    leads = first.copy()
    if b is not None:
        first[1:] |= b[order[1:]] != b[order[:-1]]
    starts, run = np.flatnonzero(first), np.cumsum(first) - 1
    out = np.zeros((1 if least or b is None else 3, len(a)), bool)
    if least:
        out[0, order] = np.minimum.reduceat(v[order], starts)[run] < v[order]
    else:
        total = np.add.reduceat(1 + flagged[order].astype(np.int64), starts)
        out[0, order] = (total > 1)[run]
        if b is not None:
            out[1, order] = first
            out[2, order] = (np.add.reduceat(first.astype(np.int64), np.flatnonzero(leads)) > 1)[np.cumsum(leads) - 1]
    return out


def bits_of(answers: list | None, n: int = 1) -> list[np.ndarray]:
    """All answers of each of a unit's ``n`` blocks, in the order of its keys, a row for each kind."""
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    for r in sorted(answers or [], key=lambda r: r["bucket"]):
        total = sum(r["sizes"])
        rows, at = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["kinds"] * total).reshape(r["kinds"], total), 0
        for own, size in zip(out, r["sizes"], strict=True):
            own.append(rows[:, at : at + size])
            at += size
    return [np.concatenate(x, axis=1).astype(bool) if x else np.zeros((3, 0), bool) for x in out]


def finish(blocks: Blocks, schema: T.StructType, fields: T.StructType, make: Callable) -> DataFrame:
    """The documents of the blocks with ``fields``, which ``make()(rows, answers)`` gives; columns of the same names are replaced."""
    new = set(fields.names)
    kept = [f for f in schema.fields if f.name not in new]
    out = T.StructType([*kept, *fields.fields])
    keep, names = [f.name for f in kept], out.names
    replies = blocks.replies()

    def run(batches):
        fn = make()
        for batch in batches:
            for k in range(batch.num_rows):
                for rows, told in each_block(batch, replies, k):
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *fn(rows, told)], names=names)

    return blocks.frame.mapInArrow(run, out)
