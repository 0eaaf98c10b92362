"""Search by keywords and vectors, fusion, re-ranking, and collections."""

import json
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.operators import keywords, rerank, retrieval
from folioweave.sources.collection import Collection, Conflict

WORDS = ["the", "kata", "Buku", "é1", "harga", "naik", "12", "pasal", "ia", "x"]


def brute_bm25(docs, queries, k):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {}
    for d, t in docs:
        if d is not None:
            bags.setdefault(d, Counter()).update(split(t))
    n, df = len(bags), Counter(w for bag in bags.values() for w in bag)
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, n)
    out = []
    for q, t in queries:
        sums = Counter()
        for w, asked in Counter(split(t)).items():
            for d, bag in bags.items():
                if bag[w]:
                    part = asked * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
                    sums[d] += round(part * 1e9)
        out += [(q, r, d, s / 1e9) for r, (d, s) in enumerate(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize(("slot", "frequent"), [(100_000, 0.05), (7, 0.3), (7, 2.0)])
def test_keyword_search(spark, tmp_path, monkeypatch, slot, frequent):
    monkeypatch.setattr(keywords, "FREQUENT", frequent)
    rnd = random.Random(slot)
    docs = [(k, "the " + " ".join([*rnd.choices(WORDS, k=rnd.randint(0, 30)), *["rare"] * (k % 9 == 0), f"own{k % 20}"])) for k in range(60)] + [(3, "kata kata"), (None, "kata"), (70, None), (71, ""), (72, "the " * 50_000)]
    queries = [(k, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 6)))) for k in range(12)] + [(90, None), (91, "unknown"), (92, "kata, kata!"), (93, "the rare of"), (94, "the own3 rare ia"), (95, "own4 own5 the the"), (96, "rare")]
    index = keywords.build(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("own")), "doc_id", "text", slot)
    assert index.postings.agg(F.max(F.size("docs"))).first()[0] <= (63 if slot > 63 else 4 * slot)
    index.save(str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, "item long, text string")
    for held in (index, keywords.Index.load(spark, str(tmp_path / "index"))):
        found = sorted(map(tuple, keywords.search(held, asked, "item", "text", 5).collect()))
        want = brute_bm25(docs, queries, 5)
        assert [x[:3] for x in found] == [x[:3] for x in want] and [x[3] for x in found] == pytest.approx([x[3] for x in want], abs=1e-7)
    empty = keywords.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert keywords.search(empty, asked, "item", "text").collect() == [] and keywords.search(index, asked.where("item < 0"), "item", "text").collect() == []


def test_terms_of_documents_with_keys_of_their_own(spark):
    texts = ["b a, b B c", None, "", " .;", "the " * 50_000 + "end", "a", "É é x"]
    index = keywords.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 3)
    want = []
    for k, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        want += [(w, k, n, len(words)) for w, n in Counter(words).items()]
    got = index.postings.select("term", F.explode("docs").alias("d")).select("term", "d.key", "d.times", "d.length")
    assert sorted(map(tuple, got.collect())) == sorted(want) and index.documents == len(texts) and index.words == sum(x[2] for x in want)


@pytest.mark.parametrize("frequent", [0.05, 2.0])
def test_keyword_index_is_made_where_texts_are_read(spark, tmp_path, monkeypatch, frequent):
    """Postings and parts of scores aren't shuffled; blocks are cut by bytes, queries and parts in slices, and the results stay."""
    for name, value in (("BLOCK", 200), ("QUERIES", 3), ("PARTS", 5), ("FREQUENT", frequent)):
        monkeypatch.setattr(keywords, name, value)
    docs = [(f"k{k:03}", " ".join(random.Random(k).choices(WORDS, k=k % 12)) + " the" * (k % 7 == 0)) for k in range(80)] + [("K", "kata"), ("", "kata")]
    table = spark.createDataFrame(docs, "id string, text string").coalesce(3)
    index = keywords.build(table, "id", "text")
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    index.save(str(tmp_path / "index"))
    queries = [(f"q{k}", t) for k, t in enumerate(["kata", "KATA kata naik", "the ia 12", "é1", "pasal harga the x buku", "none", "", "naik naik naik"])]
    asked = spark.createDataFrame(queries, "item string, text string")
    held = keywords.Index.load(spark, str(tmp_path / "index"))
    moved = keywords.search(held, asked, "item", "text", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in moved.split("MapInArrow")[0]
    for one in (index, held):
        found = sorted(map(tuple, keywords.search(one, asked, "item", "text", 3).collect()))
        want = brute_bm25(docs, queries, 3)
        assert [x[:3] for x in found] == [x[:3] for x in want] and [x[3] for x in found] == pytest.approx([x[3] for x in want], abs=1e-7)
    assert index.words == held.words == sum(len(t.split()) for _, t in docs)
    assert {r["term"]: r["docs"] for r in index.terms.collect()} == Counter(w for _, t in docs for w in set(t.lower().split()))


@pytest.mark.parametrize("frequent", [0.05, 2.0])
def test_parts_that_round_to_nothing_are_found(spark, monkeypatch, frequent):
    monkeypatch.setattr(keywords, "UNIT", 1)
    monkeypatch.setattr(keywords, "FREQUENT", frequent)
    docs = spark.createDataFrame([(k, "the" if k != 5 else "") for k in range(9)], "id long, text string").coalesce(1)
    found = keywords.search(keywords.build(docs, "id", "text"), spark.createDataFrame([(1, "the the"), (2, "the")], "item long, text string"), "item", "text", 20)
    assert sorted(map(tuple, found.collect())) == [(q, r, d, 0.0) for q in (1, 2) for r, d in enumerate([0, 1, 2, 3, 4, 6, 7, 8])]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (2, 0, 5)], "query long, rank int, key long")
    b = spark.createDataFrame([(1, 0, 20), (1, 1, 30)], "query long, rank int, key long")
    found = keywords.fused({"a": a, "b": b}, 2, {"b": 0.5}).orderBy("query", "rank").collect()
    assert [(r["query"], r["rank"], r["key"], r["a"], r["b"]) for r in found] == [(1, 0, 20, 1, 0), (1, 1, 10, 0, None), (2, 0, 5, 0, None)]
    assert found[0]["score"] == pytest.approx(1 / 62 + 0.5 / 61, abs=1e-9)


def _vectors(n, seed=1, decay=0.0, dimensions=24):
    rnd = np.random.default_rng(seed)
    return rnd.normal(size=(n, dimensions)) * np.exp(-decay * np.arange(dimensions))


def _table(spark, vectors):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, (10_000, None), (None, rows[0][1]), (10_001, [0.0] * len(vectors[0]))], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("block", [4096, 7])
def test_search_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERIES", block)
    vectors = _vectors(60)
    vectors[50:55] = vectors[3]
    chunks = _table(spark, vectors)
    queries = chunks.where("id % 3 = 0")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12)
    for k in (1, 5, 100):
        found = retrieval.search(chunks, "v", "id", queries, "v", "id", k).collect()
        got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in found if r["query"] < 60}
        for q in range(0, 60, 3):
            own = [(k_, near[q, k_]) for k_ in range(60)] + [(10_001, 0.0)]
            want = sorted(own, key=lambda x: (-x[1], x[0]))[:k]
            assert [got[q, r][1] for r in range(len(want))] == pytest.approx([1 - s for _, s in want], abs=1e-9)
            assert {got[q, r][0] for r in range(len(want)) if want[r][1] > want[-1][1]} == {i for i, s in want if s > want[-1][1]}
    assert retrieval.search(chunks, "v", "id", queries.limit(0), "v", "id").collect() == [] and retrieval.search(chunks.limit(0), "v", "id", queries, "v", "id").collect() == []


@pytest.mark.parametrize(("block", "pairs"), [(4096, 5), (7, 15)])
def test_few_queries_read_chunks_once(spark, monkeypatch, block, pairs):
    """Queries out of all partitions of a table are one partition for each block that they fill, not as many as the table has."""
    monkeypatch.setattr(retrieval, "QUERIES", block)
    monkeypatch.setattr(retrieval, "_ranked", lambda found, key, k: found)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        chunks = _table(spark, _vectors(60)).repartition(5)
        found = retrieval.search(chunks, "v", "id", chunks.where("id % 3 = 0"), "v", "id", 3)
        assert found.rdd.getNumPartitions() == pairs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("block", "decay", "k"), [(4096, 0.6, 5), (7, 0.6, 5), (7, 0.0, 3), (4096, 0.6, 500)])
def test_truncated_search_is_full_search(spark, monkeypatch, block, decay, k):
    monkeypatch.setattr(retrieval, "QUERIES", block)
    chunks = _table(spark, _vectors(200, 2, decay))
    queries = chunks.where("id % 10 = 0")
    full = {(r["query"], r["rank"]): (r["id"], round(r["score"], 9)) for r in retrieval.search(chunks, "v", "id", queries, "v", "id", k).collect()}
    found, effort = retrieval.truncated_search(chunks, "v", "id", queries, "v", "id", 8, k)
    assert {(r["query"], r["rank"]): (r["id"], round(r["score"], 9)) for r in found.collect()} == full
    rows = effort.collect()
    assert {r["query"] for r in rows} == {q for q, _ in full} and all(r["chunks"] == 201 and min(k, 201) <= r["scored"] <= 201 for r in rows)
    if decay and k == 5:
        assert sum(r["scored"] for r in rows) < 0.4 * sum(r["chunks"] for r in rows)


def test_many_diverse_searches_are_single_ones(spark):
    vectors = _vectors(40, 3)
    chunks = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, v array<double>")
    found = retrieval.mmr_many(chunks, "v", "id", chunks.where("id % 10 = 0"), "v", "id", 4, 12, 0.3).collect()
    for q in range(0, 40, 10):
        want = [r["id"] for r in retrieval.mmr(chunks, "v", list(map(float, vectors[q])), "id", 4, 12, 0.3).collect()]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q] == want


def test_rerank_by_late_interaction(spark):
    rnd = np.random.default_rng(4)
    queries = {q: rnd.normal(size=(3, 8)) for q in range(4)}
    chunks = {c: rnd.normal(size=(c % 5, 8)) for c in range(15)}
    candidates = [(q, c) for q in range(5) for c in range(20) if (q + c) % 2 == 0] * 2
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = lambda q, c: float((unit(queries[q]) @ unit(chunks[c]).T).max(axis=1).sum()) if len(chunks[c]) else 0.0
    want = {q: sorted({(round(-score(a, c), 9), c) for a, c in candidates if a == q and c in chunks})[:4] for q in queries}
    frame = lambda sets, name: spark.createDataFrame([(k, [[float(x) for x in v] for v in m]) for k, m in sets.items()] + [(99, None)], f"{name} long, vectors array<array<double>>")
    asked = spark.createDataFrame(candidates, "query long, key long")
    found = rerank.rerank(asked, frame(queries, "query"), frame(chunks, "key")).collect()
    assert {q: [(round(-r["score"], 9), r["key"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q] for q in queries} == want
    by_size = rerank.rerank(asked, frame(queries, "query"), frame(chunks, "key"), k=1, score=lambda q, c: F.size(c).cast("double"))
    assert {r["query"]: r["key"] for r in by_size.collect()} == {0: 4, 1: 9, 2: 4, 3: 9}


def test_best_of_rows_are_those_of_a_stable_sort():
    rnd = np.random.default_rng(6)
    for n, k in ((1, 3), (7, 2), (50, 5), (50, 12), (400, 5)):
        near = rnd.integers(-4, 5, size=(30, n)) / 4
        near[::3, ::2] = np.nan
        row, at = retrieval._best(near, k)
        want = np.argsort(-near, axis=1, kind="stable")[:, :k]
        assert row.tolist() == np.repeat(np.arange(30), want.shape[1]).tolist() and at.tolist() == want.ravel().tolist()


@pytest.mark.parametrize("size", [4096, 7])
def test_rerank_of_vectors_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(rerank, "QUERIES", size)
    rnd = np.random.default_rng(5)
    queries = {q: rnd.normal(size=(3, 8)) for q in range(6)}
    chunks = {c: rnd.normal(size=(1 + 3 * (c % 9), 8)) for c in range(15)} | {20: rnd.normal(size=(60, 8))}
    chunks[14] = chunks[3]
    candidates = [(q, c) for q in range(7) for c in [*range(16), 20] if (q + c) % 3 or c == 20] * 2
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = lambda q, c: float((unit(queries[q]) @ unit(chunks[c]).T).max(axis=1).sum())
    want = {q: sorted({(round(-score(a, c), 9), c) for a, c in candidates if a == q and c in chunks})[:5] for q in queries}
    frame = lambda sets, name: spark.createDataFrame([(k, [float(x) for x in v]) for k, m in sets.items() for v in m] + [(99, None), (1, None)], f"{name} long, vector array<float>").repartition(3)
    found = rerank.rerank_vectors(spark.createDataFrame(candidates, "query long, key long"), frame(queries, "query"), frame(chunks, "key"), k=5)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert {q: [(round(-r["score"], 5), r["key"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] for q in queries} == {q: [(round(s, 5), c) for s, c in x] for q, x in want.items()}


def _files(path):
    return {str(f.relative_to(path)) for f in Path(path).glob("data/*/*/*.parquet")}


def test_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    frame = lambda rows: spark.createDataFrame(rows, "id string, n long, tags array<string>")
    held = Collection.create(frame([(f"k{k}", k, None) for k in range(100)] + [("k1", 7, ["again"])]), path, "id", 16)
    assert held.read().count() == 100
    first = _files(path)
    assert held.add(frame([("k5", 500, None), ("new", 1, ["a"]), ("new", 1, ["a"])])) == 1
    assert held.update(frame([("k6", 600, None), ("none", 2, None)])) == 2
    assert held.upsert(frame([("k7", 700, None), ("more", 3, None)])) == 3
    assert held.delete(frame([("k8", None, None), ("none", None, None)])) == 4
    rows = {r["id"]: r["n"] for r in held.read().collect()}
    assert len(rows) == 101 and (rows["k5"], rows["k6"], rows["k7"], rows["new"], rows["more"]) == (5, 600, 700, 1, 3) and not {"none", "k8"} & set(rows)
    assert {r["id"]: r["n"] for r in held.read(1).collect()}["k6"] == 6 and held.versions() == [0, 1, 2, 3, 4]
    # each change wrote the buckets of its ids only
    buckets = [held.manifest(v)["buckets"] for v in held.versions()]
    assert all(sum(a[b] != after.get(b) for b in a) <= 2 for a, after in zip(buckets, buckets[1:], strict=False)) and first <= _files(path)
    assert {r["id"] for r in held.get(frame([("k1", None, None), ("gone", None, None), (None, None, None)])).collect()} == {"k1"}
    gone = held.vacuum()
    assert gone and held.versions() == [4] and _files(path) == {f for f in _files(path) if f.split("/")[1] + "/" + f.split("/")[2] in held.manifest()["buckets"].values()}
    assert {r["id"]: r["n"] for r in Collection(spark, path).read().collect()} == rows


def test_a_collection_is_whole_after_a_crash_and_refuses_conflicts(spark, tmp_path, monkeypatch):
    from folioweave.sources import collection as module

    path = str(tmp_path / "c")
    frame = lambda rows: spark.createDataFrame(rows, "id long, n long")
    held = Collection.create(frame([(k, k) for k in range(20)]), path, "id", 4)
    with monkeypatch.context() as m:
        m.setattr(module.Folder, "create", lambda *_: (_ for _ in ()).throw(RuntimeError("the power went")))
        with pytest.raises(RuntimeError, match="power"):
            held.upsert(frame([(1, 100)]))
    assert {r["id"]: r["n"] for r in held.read().collect()} == {k: k for k in range(20)}
    assert len(held.vacuum()) == 1
    late = held.manifest()
    held.upsert(frame([(1, 100)]))
    with monkeypatch.context() as m:
        m.setattr(held, "manifest", lambda *_: late)
        with pytest.raises(Conflict):
            held.upsert(frame([(2, 200)]))
    assert {r["id"]: r["n"] for r in held.read().collect()} == {k: 100 if k == 1 else k for k in range(20)}
    for bad in (frame([(None, 1)]), frame([(1, 1)]).withColumn("odd", F.lit(1))):
        with pytest.raises(ValueError, match="without id|odd"):
            held.add(bad)
    empty = Collection.create(frame([]), str(tmp_path / "e"), "id")
    assert empty.read().count() == 0 and empty.add(frame([(1, 1)]).select("id")) == 1 and [tuple(r) for r in empty.read().collect()] == [(1, None)]
    assert json.loads((tmp_path / "e" / "versions" / "1.json").read_text())["count"] == 64
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "nothing"))
