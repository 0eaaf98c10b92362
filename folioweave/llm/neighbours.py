"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree is fitted on a bounded sample; every vector goes to the leaf that it falls to. A query visits leaves best bin
first: a priority queue holds the nodes seen, by the distance of their centres, and the nearest is opened next. How many
leaves a query visits is calibrated on the whole table: some queries are held against all vectors, and visits widen
until the wanted share of the true neighbours lies in visited leaves.

A leaf that can't hold a neighbour isn't visited: each leaf's radius is known, the fitted vectors near a query bound the
distance of its k-th neighbour from above, and by the triangle inequality a leaf whose ball lies beyond that has none.
This loses nothing. It spares clustered tables most visits; of vectors without clusters nearly all balls overlap, and a
search remains near brute force.

Equal vectors are one vector with the k + 1 smallest of their ids, which are all that a list of k can name. Leaves are
dealt over blocks of bounded size, large ones over several. A block's vectors are sorted before its queries, which then
pass by them in batches: no task holds more than a block and a batch, and no vector of the table is sent twice, however many queries
there are. Batches are compared by one matrix product, and what may be among the k nearest by its exact distance.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another
length than the most common one (the shorter of two) or without an id; ties go to smaller ids; a repeated id is one
vector's id once, and a row with the query's own id is no candidate; fewer than k candidates make shorter lists; an empty
table gives no rows; columns beside the key and the vector are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import handed, lookup, materialise

K, RECALL = 10, 0.97
#: Bounds: vectors that the tree is fitted on and their bytes, its leaves (as many as the root of the table's vectors, and
#: an eighth of the fitted ones at most), and queries that calibrate it; as many measure it.
SAMPLE, SAMPLE_BYTES, LEAVES, CALIBRATING = 65_536, 32 << 20, 8192, 96
BRANCHES, ROUNDS, SEED = 8, 12, 5
#: Most vectors in a block; small tables make about BLOCKS blocks of LEAST vectors or more.
BLOCK, LEAST, BLOCKS = 16_384, 1024, 64
#: Numbers in a matrix of approximate distances.
MATRIX = 4 << 20


class Tree:
    """Nodes' centres and children; ``leaf`` numbers the leaves, -1 for inner nodes."""

    def __init__(self, points: np.ndarray, leaves: int):
        rng = np.random.default_rng(SEED)
        self.centres: list[np.ndarray] = [points.mean(axis=0)]
        self.children: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.leaf = [-1]
        open_nodes, made = [(0, points, max(1, leaves))], 0
        while open_nodes:
            node, own, share = open_nodes.pop()
            parts = kmeans(own, min(BRANCHES, share), rng) if share > 1 and len(own) > 1 else []
            if len(parts) < 2:
                self.leaf[node] = made
                made += 1
                continue
            first = len(self.centres)
            self.children[node] = np.arange(first, first + len(parts))
            for centre, members in parts:
                open_nodes.append((len(self.centres), members, max(1, round(share * len(members) / len(own)))))
                self.centres.append(centre)
                self.children.append(np.zeros(0, np.int64))
                self.leaf.append(-1)
        self.n_leaves = made
        self.stacked = np.array(self.centres)
        inner = np.array(self.leaf)
        self.leaf_centres = np.zeros((made, points.shape[1]))
        self.leaf_centres[inner[inner >= 0]] = self.stacked[inner >= 0]
        # the fitted vectors by leaf
        leaf = self.fall(points)
        order = np.argsort(leaf, kind="stable")
        self.points, self.first_point = points[order].astype(np.float32 if (points == points.astype(np.float32)).all() else np.float64), np.searchsorted(leaf[order], np.arange(made + 1))

    def fall(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls to, always by the nearest child."""
        out = np.empty(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            centres = self.stacked[kids]
            pick = ((centres**2).sum(axis=1) - 2 * points[rows] @ centres.T).argmin(axis=1)
            todo += [(int(k), rows[pick == j]) for j, k in enumerate(kids) if (pick == j).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                out.append(self.leaf[node])
                continue
            far = ((self.stacked[kids] - query) ** 2).sum(axis=1)
            for d, k in zip(far.tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (d, k))
        return out


    def reach(self, query: np.ndarray, order: list[int], k: int) -> float:
        """No less than the distance of the ``k``-th nearest vector: that of the fitted ones in the first leaves of ``order``."""
        spans, n = [], 0
        for leaf in order:
            spans.append(np.arange(self.first_point[leaf], self.first_point[leaf + 1]))
            n += len(spans[-1])
            if n >= 4 * k:
                break
        if n < k:
            return np.inf
        return float(np.partition(distances(self.points[np.concatenate(spans)].astype(np.float64), query), k - 1)[k - 1])

    def beyond(self, query: np.ndarray, order: list[int], radii: np.ndarray, reach: float) -> np.ndarray:
        """Which leaves have no vector within ``reach`` for sure."""
        far = distances(self.leaf_centres[order], query)
        return far - radii[order] > reach + 1e-9 * (far + reach + 1)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and members of the clusters that have any."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    pick = None
    for _ in range(ROUNDS):
        now = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        if pick is not None and (now == pick).all():
            break
        pick = now
        centres = np.array([points[pick == j].mean(axis=0) if (pick == j).any() else centres[j] for j in range(len(centres))])
    return [(centres[j], points[pick == j]) for j in range(len(centres)) if (pick == j).any()]


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def unpacked(column: pa.Array | list[bytes], kind: str) -> np.ndarray:
    """Vectors kept as bytes of numbers of a ``kind``, as rows of a matrix of doubles."""
    found = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(found), kind).astype(np.float64).reshape(len(found), -1)


def _valid(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """``id`` and ``vec`` (numbers of a ``kind`` as bytes) of the vectors that take part."""
    v = F.col(vector).cast("array<float>" if kind == "f4" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    sizes = sorted((-r[1], r[0]) for r in rows.groupBy(F.size("v")).count().collect())
    rows = rows.where(F.size("v") == (sizes[0][1] if sizes else 0))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            flat = np.asarray(batch.column("v").flatten(), kind) + np.dtype(kind).type(0)  # no negative zero
            data = flat.reshape(n, -1) if n else flat
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in data], pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with the ``k`` + 1 smallest ids of each; equal ones of a task are put together before the shuffle."""

    def run(batches):
        for batch in batches:
            ids: dict[bytes, set[int]] = {}
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                ids.setdefault(v, set()).add(i)
            least = [sorted(x)[: k + 1] for x in ids.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["vec", "ids"])

    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return rows.mapInArrow(run, "vec binary, ids array<long>").groupBy("vec").agg(ids.alias("ids"))


def _drawn(n: int, most: int, salt: str = ""):
    """Whether a row is one of about ``most`` of ``n``."""
    mixed = F.xxhash64("vec", F.lit(salt)) if salt else F.xxhash64("vec")
    return F.pmod(mixed, F.lit(1 << 30)) <= int(min(1.0, most / max(1, n)) * (1 << 30))


def _sampled(rows: DataFrame, n: int, most: int, salt: str = "") -> DataFrame:
    """About ``most`` of ``n`` rows; of another ``salt``, others that don't hang on these."""
    return rows.where(_drawn(n, most, salt))


def _nearest(vectors: np.ndarray, ids: list[list[int]], query: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """(distance, id, row) of the ``k`` nearest ids."""
    far = distances(vectors, query)
    some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
    return sorted((float(far[r]), i, int(r)) for r in some.tolist() for i in ids[r])[:k]


def _compared(asked: pa.Table, held: pa.Table, k: int, kind: str) -> Iterator[tuple[int, float, int]]:
    """(query, distance, id) of the ``k`` nearest ids that each query has in its leaves of one block."""
    leaf = held["leaf"].to_numpy()
    data, ids, names = unpacked(held["vec"].combine_chunks(), kind), held["ids"].to_pylist(), np.unique(leaf)
    column = np.searchsorted(names, leaf)
    queries, numbers, lists = unpacked(asked["vec"].combine_chunks(), kind), asked["q"].to_pylist(), asked["leaves"].combine_chunks()
    wanted = np.searchsorted(names, lists.flatten().to_numpy(zero_copy_only=False))
    of = np.repeat(np.arange(len(numbers)), np.diff(lists.offsets.to_numpy()))
    here = np.isin(lists.flatten().to_numpy(zero_copy_only=False), names)
    size = (data**2).sum(axis=1)
    step = max(1, MATRIX // len(data))
    for a in range(0, len(numbers), step):
        part = queries[a : a + step]
        visits = np.zeros((len(part), len(names)), bool)
        mine = here & (of >= a) & (of < a + step)
        visits[of[mine] - a, wanted[mine]] = True
        own = (part**2).sum(axis=1)[:, None]
        near = own + size - 2 * part @ data.T
        near[~visits[:, column]] = np.inf
        # the matrix product may be off by its rounding; exact distances decide
        limit = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if near.shape[1] > k else np.full((len(part), 1), np.inf)
        row, at = np.nonzero((near <= limit + 1e-9 * (own + size.max())) & (near < np.inf))
        far = np.sqrt(((data[at] - part[row]) ** 2).sum(axis=1)).tolist()
        cuts = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
        for j, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for d, i in sorted((far[z], i) for z in range(x, y) for i in ids[at[z]])[:k]:
                yield numbers[a + j], d, i


class Index:
    """The fitted tree, the vectors with their leaves (``vec``, ``ids``, ``leaf``), and leaves to visit."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL):
        self.k = k
        self.kind = kind = "f4" if dict(vectors.dtypes)[vector] == "array<float>" else "f8"
        self.rows = materialise(_valid(vectors, key, vector, kind))
        classes = materialise(_classes(self.rows, k))
        self.n, width = classes.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
        self.tree = None
        if not self.n:
            return
        most = max(1, min(SAMPLE, SAMPLE_BYTES // width))
        points = unpacked(_sampled(classes, self.n, most).select("vec").toArrow()["vec"].combine_chunks(), kind)
        points = points[np.lexsort(points.T)] if len(points) else unpacked([r[0] for r in classes.limit(1).select("vec").collect()], kind)
        self.tree = Tree(points, min(LEAVES, int(np.ceil(np.sqrt(self.n))), max(1, len(points) // 8)))
        tree = handed(classes.sparkSession, self.tree)

        def run(batches):
            for batch in batches:
                data = unpacked(batch.column("vec"), kind) if batch.num_rows else np.zeros((0, tree().stacked.shape[1]))
                leaf = tree().fall(data)
                far = distances(data, tree().leaf_centres[leaf])
                yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("ids"), pa.array(leaf, pa.int32()), pa.array(far)], names=["vec", "ids", "leaf", "far"])

        self.vectors = materialise(classes.mapInArrow(run, "vec binary, ids array<long>, leaf int, far double"))
        self.visits, self.recall = self._calibrate(recall, most)

    def _calibrate(self, recall: float, fitted: int) -> tuple[int, float]:
        """Leaves to visit for ``recall`` of the true neighbours of some vectors, and the recall that this gives for others.

        Neither are among the tree's own vectors, unless a table has hardly any besides these; where it has too few for
        others, the same ones are measured.
        """
        enough = self.n > fitted + 2 * CALIBRATING
        apart = self.vectors.where(~_drawn(self.n, fitted)) if enough else self.vectors
        some = _sampled(apart.select("vec"), self.n - fitted if enough else self.n, 2 * CALIBRATING, "calibrating").select("vec").toArrow()["vec"].to_pylist() or [r[0] for r in self.vectors.select("vec").limit(1).collect()]
        some.sort(key=lambda v: hashlib.sha1(v).digest())
        kind, k = self.kind, self.k
        queries = unpacked(some, kind)
        sent = self.vectors.sparkSession.sparkContext.broadcast(queries)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, ids, leaf = unpacked(batch.column("vec"), kind), batch.column("ids").to_pylist(), batch.column("leaf").to_pylist()
                rows = [(q, d, i, leaf[r]) for q, query in enumerate(sent.value) for d, i, r in _nearest(data, ids, query, k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["q", "d", "id", "leaf"])

        best = F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "leaf"))), 1, k + 1)
        truth = self.vectors.mapInArrow(run, "q int, d double, id long, leaf int").groupBy("q").agg(best.alias("best")).collect()
        ranks, measured = [], []
        for r in truth:
            order = {leaf: j for j, leaf in enumerate(self.tree.visits(queries[r["q"]], self.tree.n_leaves), 1)}
            # the first one is the vector itself, and no neighbour
            (measured if r["q"] % 2 and self.n > 2 * CALIBRATING else ranks).extend(order[x["leaf"]] for x in r["best"][1:])
        ranks = np.sort(ranks) if ranks else np.ones(1, np.int64)
        visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
        return visits, float((np.array(measured or ranks) <= visits).mean())

    def search(self, wanted) -> DataFrame:
        """The nearest found of each vector whose id fulfils ``wanted`` (a condition on ``id``): query_id, rank, vec_id, score."""
        spark, k, kind = self.rows.sparkSession, self.k, self.kind
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.n:
            return spark.createDataFrame([], schema)
        asked = self.rows.where(wanted)
        queries = materialise(asked.groupBy("vec").agg(F.min("id").alias("q"), F.count(F.lit(1)).alias("_times")))
        first, parts, radii = self._blocks()
        sent = handed(spark, (self.tree, first, parts, radii, self.visits))

        def route(batches):
            tree, first, parts, radii, most = sent()
            for batch in batches:
                rows = []
                for q, v in zip(*(batch.column(c).to_pylist() for c in ("q", "vec")), strict=True):
                    query = unpacked([v], kind)[0]
                    order = tree.visits(query, most)
                    out = tree.beyond(query, order, radii, tree.reach(query, order, k + 1))
                    at: dict[int, list[int]] = {}
                    for leaf in np.array(order)[~out].tolist():
                        for b in range(first[leaf], first[leaf] + parts[leaf]):
                            at.setdefault(b, []).append(leaf)
                    rows += [(b, q, v, leaves) for b, leaves in at.items()]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "q", "vec", "leaves"])

        def place(batches):
            _, first, parts, _, _ = sent()
            for batch in batches:
                leaf = batch.column("leaf").to_numpy()
                block = np.array(first)[leaf] + batch.column("salt").to_numpy() % np.array(parts)[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(batch.column(c) for c in ("vec", "ids", "leaf"))], names=["block", "vec", "ids", "leaf"])

        def match(batches):
            block, held = None, []
            for batch in batches:
                blocks = batch.column("block").to_numpy()
                for a, b in zip(at := [*np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)).tolist(), len(blocks)], at[1:], strict=False):
                    rows = pa.Table.from_batches([batch.slice(a, b - a)])
                    if blocks[a] != block:
                        block, held = int(blocks[a]), []
                    own = pc.is_valid(rows["ids"])
                    if pc.any(own).as_py():
                        held.append(rows.filter(own))
                    asked = rows.filter(pc.invert(own))
                    if not asked.num_rows or not held:
                        continue
                    held = [pa.concat_tables(held).combine_chunks()]
                    found = list(zip(*_compared(asked, held[0], k + 1, kind), strict=True)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["q", "score", "vec_id"])

        routed = queries.select("q", "vec").mapInArrow(route, "block int, q long, vec binary, leaves array<int>")
        held = self.vectors.withColumn("salt", F.pmod(F.xxhash64("vec"), F.lit(1 << 20)))
        held = held.mapInArrow(place, "block int, vec binary, ids array<long>, leaf int")
        both = held.unionByName(routed, allowMissingColumns=True)
        # a block's vectors, which have ids, come before its queries
        found = both.repartition("block").sortWithinPartitions("block", F.col("ids").isNull()).mapInArrow(match, "q long, score double, vec_id long")
        best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1)
        answers = found.groupBy("q").agg(best.alias("best"))
        answers = materialise(queries.join(answers, "q").select("vec", "best", "_times"))
        out = lookup(asked, answers, "vec", "_times")
        others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
        out = out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "near"))
        return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))

    def _blocks(self) -> tuple[list[int], list[int], np.ndarray]:
        """Of each leaf its first block, over how many blocks it is dealt, and its radius."""
        found = self.vectors.groupBy("leaf").agg(F.count(F.lit(1)), F.max("far")).collect()
        sizes, radii = {r[0]: r[1] for r in found}, np.zeros(self.tree.n_leaves)
        radii[[r[0] for r in found]] = [r[2] for r in found]
        most = min(BLOCK, max(LEAST, self.n // BLOCKS))
        first, parts, block, held = [], [], 0, 0
        for leaf in range(self.tree.n_leaves):
            n = sizes.get(leaf, 0)
            if n > most:
                block, held = block + (held > 0), 0
                first.append(block)
                parts.append(-(-n // most))
                block += parts[-1]
                continue
            if held + n > most:
                block, held = block + 1, 0
            first.append(block)
            parts.append(1)
            held += n
        return first, parts, radii
