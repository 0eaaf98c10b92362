"""A key-value store's states from a log of interleaved transactions.

Each source runs one transaction after another: changes of keys, savepoints, rollbacks to the latest savepoint (or to the start),
and a commit or an abort that ends it; what the log's end leaves open is aborted. Commits apply what is left of their
transactions to one store; every ``EPOCH`` commits end an epoch.

The log is put into order over ranges of ids and numbered. Counts up to a range, by source for transactions and over all for commits,
are prefix sums over ranges, and counts within one are windows, so no source is gathered. Transactions are dealt over
tasks, where NumPy simulates all that a task holds at once: step k takes the k-th record of each transaction still running,
on stacks that lie in two arrays. Transactions lie in order of their lengths, so those that are finished are cut off the end.

The changes that survive are shuffled by key and block of epochs. A block holds a bounded part of all epochs: within it each write
of a key is held against the one before, the first against the last of earlier blocks, and what each epoch changes in the
number of keys and in the sum of checksums is summed up to it, again within blocks and then over them. A key with
any number of writes is spread over blocks, and only its last write in each epoch counts.

Bounds: what is numbered over all ranges or blocks has one row for each of these, RANGES and BLOCKS at most. Texts stay where
they are read: what moves is their checksum. A task holds the transactions of its share whole, as some numbers a record.

Cases: a null text, or a toxic document, deletes its key, also where nothing is stored; rows without an id aren't in the log;
a null source is one source; rows that repeat an id are records in the order of source (null first), deletion and checksum;
an empty log, or one without a commit, has no epochs; labels may repeat ids, and any that says toxic counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.common import materialise

# What the remainder of a record's hash by PERIOD means, below each of these; anything else is a change
PERIOD, COMMIT_BELOW, ABORT_BELOW, SAVE_BELOW, ROLL_BELOW = 23, 2, 3, 5, 7
KEYS, KEY_STEP, EPOCH = 300, 100, 4
COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = range(5)
#: Records for which a range is made, ranges and blocks of epochs at most, and records that are simulated together.
RECORDS, RANGES, BLOCKS, TOGETHER = 1 << 20, 4096, 1024, 1 << 18


def logged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as log records in order: ``at`` (ascending, in ranges of ``at >> 33``), id, source, op, key, gone and crc (of ``key:text``)."""
    spark = docs.sparkSession
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    kind = h % PERIOD
    op = F.when(kind < COMMIT_BELOW, COMMIT).when(kind < ABORT_BELOW, ABORT).when(kind < SAVE_BELOW, SAVEPOINT).when(kind < ROLL_BELOW, ROLLBACK).otherwise(CHANGE)
    key = F.when(op == CHANGE, F.floor(h / KEY_STEP) % KEYS)
    written = F.when(op == CHANGE, F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary")))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), op.cast("int").alias("op"), key.cast("int").alias("key"), written.alias("crc"))
    toxic = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id")).distinct().withColumn("toxic", F.lit(True))
    rows = rows.join(toxic, "id", "left").withColumn("gone", F.col("toxic").isNotNull() | F.col("crc").isNull()).drop("toxic")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, -(-docs.count() // RECORDS)))
    order = ("id", "source", "gone", "crc")
    return materialise(rows.repartitionByRange(min(n, RANGES), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def numbered(log: DataFrame) -> DataFrame:
    """``log`` with ``tx``, the number of its transaction among those of the source, and ``nth``, that of the commits up to it, in the whole log."""
    log = log.withColumn("range", F.shiftright("at", 33))
    ends, commits = ((F.col("op") <= ABORT).cast("long"), (F.col("op") == COMMIT).cast("long"))
    before = lambda w: w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = log.groupBy("range", "source").agg(F.sum(ends).alias("ends"), F.sum(commits).alias("commits"))
    earlier = sums.select("range", "source", F.coalesce(F.sum("ends").over(before(Window.partitionBy("source"))), F.lit(0)).alias("tx0"))
    # one row for each range
    total = sums.groupBy("range").agg(F.sum("commits").alias("commits"))
    total = total.select("range", F.coalesce(F.sum("commits").over(before(Window.partitionBy())), F.lit(0)).alias("nth0"))
    own = Window.partitionBy("range").orderBy("at")
    log = log.withColumn("nth", F.sum(commits).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    by_source = Window.partitionBy("range", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("tx", F.coalesce(F.sum(ends).over(by_source), F.lit(0)))
    offsets = earlier.join(total, "range").select(F.col("range").alias("_range"), F.col("source").alias("_source"), "tx0", "nth0")
    found = log.join(offsets, (F.col("range") == F.col("_range")) & F.col("source").eqNullSafe(F.col("_source")))
    return found.select("source", (F.col("tx") + F.col("tx0")).alias("tx"), "at", "id", "op", "key", "gone", "crc", (F.col("nth") + F.col("nth0")).alias("nth"))


def simulate(starts: np.ndarray, op: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What becomes of each record: the record that undoes or commits it (-1: the log's end, or it is no change), and whether that is its own transaction's commit.

    Records lie by transaction, which begin at ``starts``. All transactions take their k-th record in step k.
    """
    n = len(op)
    by, kept = np.full(n, -1, np.int64), np.zeros(n, bool)
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    lanes, sizes = starts[order], sizes[order]
    # a lane's stacks have room for a number from each of its records: changes that remain, and how many there were at each savepoint
    changes, saved = np.empty(n, np.int64), np.empty(n, np.int64)
    n_changes, n_saved = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)

    def take(lane: np.ndarray, down_to: np.ndarray, record: np.ndarray) -> np.ndarray:
        """Pops the changes of these lanes to a depth; which they are. ``record`` is what did it."""
        many = n_changes[lane] - down_to
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        popped = changes[np.repeat(lanes[lane] + down_to, many) + within]
        by[popped] = np.repeat(record, many)
        n_changes[lane] = down_to
        return popped

    running = len(lanes)
    for k in range(sizes[0] if running else 0):
        running = np.searchsorted(-sizes[:running], -k)  # lanes of more than k records
        record = lanes[:running] + k
        what = op[record]
        lane = np.flatnonzero(what == CHANGE)
        changes[lanes[lane] + n_changes[lane]] = record[lane]
        n_changes[lane] += 1
        lane = np.flatnonzero(what == SAVEPOINT)
        saved[lanes[lane] + n_saved[lane]] = n_changes[lane]
        n_saved[lane] += 1
        lane = np.flatnonzero(what == ROLLBACK)
        held = n_saved[lane] > 0
        n_saved[lane] -= held
        take(lane, np.where(held, saved[lanes[lane] + n_saved[lane]], 0), record[lane])
        lane = np.flatnonzero(what == ABORT)
        take(lane, np.zeros(len(lane), np.int64), record[lane])
        lane = np.flatnonzero(what == COMMIT)
        kept[take(lane, np.zeros(len(lane), np.int64), record[lane])] = True
    return by, kept


def fates(records: DataFrame) -> DataFrame:
    """A row for each change: id, key, gone, crc, at; ``fate``, what befell it (COMMIT, ROLLBACK or ABORT); ``by``, the id of what did it; ``nth`` of the commit."""
    names = ["id", "key", "gone", "crc", "at", "fate", "by", "nth"]

    def run(batches):
        def done(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            op, ids, nth = (rows.column(c).to_numpy() for c in ("op", "id", "nth"))
            by, kept = simulate(edges, op)
            at = np.flatnonzero(op == CHANGE)
            by, kept = by[at], kept[at]
            fate = np.where(kept, COMMIT, np.where(by < 0, ABORT, np.where(op[by] == ROLLBACK, ROLLBACK, ABORT))).astype(np.int32)
            own = rows.take(pa.array(at)).combine_chunks()
            made = [pa.array(fate), pa.array(ids[by], mask=by < 0), pa.array(nth[by], mask=~kept)]
            return pa.table([*(own.column(c) for c in names[:5]), *made], names=names)

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < TOGETHER:
                continue
            edges = _edges(held)
            if len(edges) > 1:  # the last transaction may go on
                yield from done(held.slice(0, edges[-1]), edges[:-1]).to_batches()
                held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from done(held, _edges(held)).to_batches()

    dealt = records.repartition("source", "tx").sortWithinPartitions("source", "tx", "at")
    return dealt.mapInArrow(run, "id long, key int, gone boolean, crc long, at long, fate int, by long, nth long")


def _edges(rows: pa.Table) -> np.ndarray:
    """Where transactions begin."""
    source = rows.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    tx = rows.column("tx").to_numpy()
    return np.flatnonzero(np.append(True, (source[1:] != source[:-1]) | (tx[1:] != tx[:-1])))


def states(changes: DataFrame, commits: int) -> DataFrame:
    """For each epoch ``epoch``, the number of stored keys ``n`` and the sum of their checksums ``value``."""
    spark = changes.sparkSession
    epochs = -(-commits // EPOCH)
    per = max(1, -(-epochs // BLOCKS))
    block = F.floor((F.col("epoch") - 1) / per).cast("long")
    epoch = F.floor((F.col("nth") - 1) / EPOCH).cast("long") + 1
    survive = changes.where(F.col("fate") == COMMIT).select("key", epoch.alias("epoch"), F.struct(F.when(~F.col("gone"), F.col("crc")).alias("crc")).alias("now"), F.struct("nth", "at").alias("when"))
    last = materialise(survive.groupBy("key", "epoch").agg(F.max_by("now", "when").alias("now")).withColumn("block", block))
    before = last.withColumn("before", F.lag("now").over(Window.partitionBy("key", "block").orderBy("epoch")))
    # a key has one row for each block here
    ends = last.groupBy("key", "block").agg(F.max_by("now", "epoch").alias("now"))
    carried = ends.select("key", "block", F.lag("now").over(Window.partitionBy("key").orderBy("block")).alias("carried"))
    steps = before.join(carried, ["key", "block"]).select("epoch", F.col("now.crc").alias("now"), F.coalesce("before", "carried")["crc"].alias("before"))
    stored = lambda c: F.col(c).isNotNull().cast("long")
    value = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    steps = steps.select("epoch", (stored("now") - stored("before")).alias("n"), (value("now") - value("before")).alias("value"))
    none = spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("value"))
    steps = materialise(steps.unionByName(none).groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).withColumn("block", block))
    so_far = Window.partitionBy("block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each block
    earlier = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy("block").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    totals = totals.select("block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "value")))
    inner = steps.select("block", "epoch", *(F.sum(c).over(so_far).alias(c) for c in ("n", "value")))
    return inner.join(totals, "block").select("epoch", (F.col("n") + F.col("n0")).alias("n"), (F.col("value") + F.col("value0")).alias("value"))


def reassemble(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``states`` of the log, and the ``fates`` of its changes."""
    log = logged(docs, labels)
    changes = materialise(fates(numbered(log)))
    commits = log.where(F.col("op") == COMMIT).count()
    return states(changes, commits), changes


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, id, n, value: ``state`` for each epoch (its number, stored keys, sum), ``abort`` or ``rollback`` for each undone change (its id, what undid it, its key)."""
    found, changes = reassemble(docs, labels)
    undone = changes.where(F.col("fate") != COMMIT)
    kind = F.when(F.col("fate") == ROLLBACK, "rollback").otherwise("abort")
    after = found.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value")
    return after.unionByName(undone.select(kind.alias("kind"), "id", F.col("by").alias("n"), F.col("key").cast("long").alias("value")))
