"""Operators that hold texts against each other, archives, and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioweave.llm import archives, common, exchange, neighbours, passages, simhash, suffixes
from folioweave.llm import queries as q
from folioweave.llm.components import components


def sha(data):
    return hashlib.sha256(data).hexdigest()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(text, items):
    """(words, hit words, items) of a text that is held against the benchmark's windows."""
    split = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, named = split(text), set(), set()
    for item, t in items:
        own = split(t)
        for i in range(max(1, len(own) - 12) if own else 0):
            w = own[i : i + 13]
            for j in range(len(words) - len(w) + 1):
                if words[j] == w[0] and words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    named |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(named)


def brute_passages(rows):
    """(doc_id, n_words, n_removed, kept) of each row."""
    last = 1 << 70
    split = [(last if d is None else d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    out = []
    for (d, w), (own, _) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((own, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def _repeating_texts(n, seed):
    """Texts that share runs of 5 to 60 words at all alignments."""
    rnd = random.Random(seed)
    common = [[f"w{rnd.randrange(400)}" for _ in range(60)] for _ in range(4)]
    texts = []
    for k in range(n):
        words = []
        for _ in range(rnd.randint(1, 4)):
            words += [f"u{k}x{rnd.randrange(999)}" for _ in range(rnd.randint(0, 15))]
            run, a = rnd.choice(common), rnd.randrange(50)
            words += run[a : a + rnd.randint(5, 30)]
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
    return texts


def _passages(docs):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], sha(bytes(r["kept"]))) for r in passages.remove_repeats(docs).collect())


@pytest.mark.parametrize("block", [exchange.BLOCK, 900])
def test_passages_against_brute_force(spark, awkward, monkeypatch, block):
    monkeypatch.setattr(exchange, "BLOCK", block)
    monkeypatch.setattr(exchange, "KEYS", 64 if block == 900 else exchange.KEYS)
    monkeypatch.setattr(exchange, "MESSAGE", 20 if block == 900 else exchange.MESSAGE)
    rows = [(k * 7 % 53, t) for k, t in enumerate(_repeating_texts(53, 4))] + [(5, "w " * 40), (None, "w " * 30), (None, "w " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if block != 900:
        docs = docs.unionByName(awkward, allowMissingColumns=True)
    assert _passages(docs) == Counter(brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_passages_query(same):
    same(q.op8_passages, q.ORACLES["op8_passages"])


def test_simhash_is_that_of_the_sql(same):
    same(q.op9_simhash, q.ORACLES["op9_simhash"])


def test_hash_of_the_sql(duck):
    chars = random.Random(1)
    texts = ["".join(chars.choice("abcé ü日x") for _ in range(n)) for n in range(150)]
    duck.execute("CREATE OR REPLACE TEMP TABLE strings AS SELECT unnest($1) AS s", [texts])
    assert dict(duck.execute(q._xxh64("strings")).fetchall()) == {t: xxhash.xxh64_intdigest(t.encode(), simhash.SEED) for t in texts}


def test_suffixes_are_those_of_the_sql(same):
    same(q.op10_suffixes, q.ORACLES["op10_suffixes"])


def test_passages_of_nothing(nothing):
    assert passages.remove_repeats(nothing).count() == 0


def test_blocks_are_not_shuffled_again(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    blocks = exchange.blocks(docs, "text")
    keys = exchange.Keys(np.arange(5, dtype=np.uint64))
    ask = lambda b: exchange.ask(b, lambda: lambda rows, told: keys, exchange.even_splitters(3))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = blocks.told(ask(blocks))
        plan = once.told(ask(once)).frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("ShuffledHashJoin") == 2
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_units_and_buckets_grow_with_the_texts():
    assert exchange.grown(0) == exchange.grown(30 << 30) == (1, exchange.KEYS)
    for size in (1 << 38, 1 << 40, 100 << 40):
        unit, keys = exchange.grown(size)
        assert unit * exchange.BLOCK * keys >= 0.9 * exchange.MESSAGE * size and unit < 256 and keys <= exchange.WIDEST * exchange.KEYS


@pytest.mark.parametrize("n", [1, 7, 118])
def test_each_slot_has_a_partition_of_its_own(spark, n):
    numbers = spark.createDataFrame([(int(x),) for x in exchange.slots(n)], "slot int").repartition(n, "slot")
    assert [tuple(r) for r in numbers.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()] == [(k, 1) for k in range(n)]


def brute_suffixes(texts):
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        marks = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 199):
            if times[t[i : i + 200]] > 1:
                marks[i] += 1
                marks[i + 200] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        out.append((len(t), int(gone.sum()), int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum()), sha(kept)))
    return out


def _suffixes(docs):
    return Counter((r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffixes.remove_repeats(docs).collect())


def _spliced(seed, n):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abé \n") for _ in range(4000))
    out = []
    for _ in range(n):
        a, b = rnd.randrange(3500), rnd.randrange(3500)
        t = list(base[a : a + rnd.randint(0, 450)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 40))) + base[b : b + rnd.randint(0, 450)])
        for _ in range(rnd.randint(0, 2)):
            if t:
                t[rnd.randrange(len(t))] = "Q"
        out.append("".join(t))
    return out


@pytest.mark.parametrize("block", [exchange.BLOCK, 3000])
def test_suffixes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exchange, "BLOCK", block)
    monkeypatch.setattr(exchange, "KEYS", 300 if block == 3000 else exchange.KEYS)
    monkeypatch.setattr(exchange, "MESSAGE", 200 if block == 3000 else exchange.MESSAGE)
    fixed = [None, "", "a" * 199, "b" * 200, "c" * 201, "d" * 1000, "ab" * 400, "x" * 200 + "y" * 200, "y" * 200 + "x" * 200]
    for seed in range(2):
        texts = fixed + _spliced(seed, 40)
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        assert _suffixes(docs) == Counter(brute_suffixes(texts))


def test_suffixes_cases(awkward, nothing):
    assert suffixes.remove_repeats(nothing).count() == 0
    got = {r["text"]: r for r in suffixes.remove_repeats(awkward).collect()}
    assert got["x" * 250_000]["n_removed"] == 250_000 and got["word " * 60_000]["n_spans"] == 1 and got[None]["n_bytes"] == 0


def test_suffixes_query(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q.op10_suffixes(spark, small).collect())
    assert got == Counter(brute_suffixes(texts))


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 4]
    root = _roots(links, distinct)
    least = defaultdict(list)
    for (d, _), p in zip(rows, prints, strict=True):
        least[root[p]] += [d] if d is not None else []
    return Counter((d, f"{p:016x}", min(least[root[p]], default=None)) for (d, _), p in zip(rows, prints, strict=True))


def test_simhash_against_brute_force(spark, awkward, small):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(50)}" for _ in range(300)]
    near = []
    for k in range(60):
        w = list(base)
        w[rnd.randrange(300)] = f"n{k}"
        near.append((1000 + k, " ".join(w)))
    docs = spark.createDataFrame(near, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    docs = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    want = brute_groups([tuple(r) for r in docs.collect()])
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


@pytest.mark.parametrize("many", [simhash.MANY, 3])
def test_links_of_close_fingerprints(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = [int(c) for c in centres]
    for c in centres[:12].tolist():
        for _ in range(30):
            p = c
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints))
    want = _roots([(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4], prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links if b in prints and a in prints) or len(links)
    assert _roots(links, prints) == want


def test_near_pairs_share_a_cell_however_often_cells_are_split():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        b = a.copy()
        for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
            b ^= np.uint64(1 << bit)
        shared = set(simhash.cells(a)[0].tolist()) & set(simhash.cells(b)[0].tolist())
        for level in range(simhash.LEVELS):
            assert shared
            settled = {c for c in shared if level and (c >> 8) & 7 == simhash.BITS}
            of = [set(simhash.finer(np.array(sorted(shared - settled), np.int64), np.repeat(x, len(shared - settled)), level)[0].tolist()) for x in (a, b)]
            shared = (of[0] & of[1]) | settled
        assert shared


def test_the_embedding_bounds_the_distance_from_below():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 500)).astype(np.uint64)
    apart = simhash._APART[simhash.embed(a).view(np.uint8).reshape(-1, 8), simhash.embed(b).view(np.uint8).reshape(-1, 8)].sum(axis=1)
    assert (apart <= np.bitwise_count(a ^ b)).all()


def test_components(spark, nothing):
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(900, k) for k in range(901, 980)] + [(5, 5)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({n for p in pairs if p[0] != p[1] for n in p})
    assert {r["node"]: r["root"] for r in components(frame).collect()} == _roots(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, ids string, vec string, leaf string, q string")


def test_neighbours_are_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(400, 6)).astype(np.float32)
    data[50:90] = data[50]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    odd = [(900, None), (901, []), (902, [0.0] * 6), (903, [float("nan")] * 6), (904, [float("inf")] + [1.0] * 5), (905, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (906, [1.0] * 5), (None, [1.0] * 6), (7, rows[7][1])]
    index = neighbours.Index(_vectors(spark, [(i, v, 0, "", "", "", "") for i, v in rows + odd]), recall=1.0)
    index.visits = index.tree.n_leaves
    got = defaultdict(list)
    for r in index.search(F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    wide = data.astype(np.float64)
    assert set(got) == set(range(0, 400, 10))
    for k, found in got.items():
        far = np.sqrt(((wide - wide[k]) ** 2).sum(axis=1))
        want = sorted((float(d), i) for i, d in enumerate(far) if i != k)[:10]
        assert [(n + 1, i) for n, (_, i) in enumerate(want)] == [(r, i) for r, i, _ in found]
        assert np.allclose([s for _, _, s in found], [d for d, _ in want], rtol=0, atol=1e-12)


def _nearest_ten(data, k):
    far = np.sqrt(((data - data[k]) ** 2).sum(axis=1))
    return [i for _, i in sorted((float(d), i) for i, d in enumerate(far) if i != k)[:10]]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_in_several_batches_and_blocks(spark, monkeypatch, kind):
    for name, value in {"BLOCK": 40, "LEAST": 40, "MATRIX": 90}.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(900, 5))
    data = data.astype(np.float32).astype(np.float64) if kind == "float" else data
    frame = spark.createDataFrame([(100 * k, [float(x) for x in v]) for k, v in enumerate(data)], f"vec_id long, embedding array<{kind}>")
    index = neighbours.Index(frame)
    index.visits = index.tree.n_leaves
    got = defaultdict(list)
    for r in index.search(F.col("id") % 1000 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {1000 * k: [100 * i for i in _nearest_ten(data, 10 * k)] for k in range(90)}


def test_far_leaves_are_not_visited_and_nothing_is_lost(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(60, 8)) * 50)[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 8))
    frame = _vectors(spark, [(k, [float(x) for x in v], 0, "", "", "", "") for k, v in enumerate(data)])
    data = data.astype(np.float32).astype(np.float64)
    index = neighbours.Index(frame)
    index.visits, (_, _, radii), tree = index.tree.n_leaves, index._blocks(), index.tree
    left = []
    for q in data[:100]:
        order = tree.visits(q, tree.n_leaves)
        left.append(np.sum(~tree.beyond(q, order, radii, tree.reach(q, order, 11))))
    assert np.mean(left) < tree.n_leaves / 4
    got = defaultdict(list)
    for r in index.search(F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {k: _nearest_ten(data, k) for k in range(0, 3000, 50)}


def test_neighbours_query_recalls_nine_of_ten(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = defaultdict(set)
    for r in q.op1_neighbours(spark, small).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for k in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((data - data[k]) ** 2).sum(axis=1))
        want = [int(ids[j]) for j in np.lexsort((ids, far)) if j != k][:10]
        hits += [i in got[int(ids[k])] for i in want]
    assert np.mean(hits) >= 0.9


def test_neighbours_calibrate_on_vectors_of_their_own(spark, monkeypatch):
    drawn, sampled = [], neighbours._sampled
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    monkeypatch.setattr(neighbours, "_sampled", lambda *a: drawn.append({bytes(r[0]) for r in sampled(*a).select("vec").collect()}) or sampled(*a))
    data = np.random.default_rng(4).normal(size=(2000, 4)).tolist()
    index = neighbours.Index(_vectors(spark, [(i, v, 0, "", "", "", "") for i, v in enumerate(data)]))
    fitted, calibrating = drawn
    assert not calibrating & fitted and 0.85 < index.recall <= 1


def test_best_bin_first_visits_every_leaf_once():
    points = np.random.default_rng(3).normal(size=(500, 4))
    tree = neighbours.Tree(points, 30)
    order = tree.visits(points[0], tree.n_leaves)
    assert sorted(order) == list(range(tree.n_leaves)) and set(tree.fall(points)) <= set(order)


def test_neighbours_of_few_and_none(spark):
    assert neighbours.Index(_vectors(spark, [])).search(F.col("id") == 0).count() == 0
    index = neighbours.Index(_vectors(spark, [(1, [1.0, 0.0], 0, "", "", "", ""), (2, [0.0, 2.0], 0, "", "", "", "")]))
    assert [tuple(r)[:3] for r in index.search(F.col("id") == 1).collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\npayload\nURL IP\n"
    data = archives.arc_version_block(version, "old.arc", "19990102030405")
    data += archives.arc_record(version, body, "http://a.b/x y", "19990102030406", offset=77, name="old.arc", ip="1.2.3.4")
    data += archives.arc_record(version, b"", None, "bad") + archives.arc_record(version, b"plain", "dns:a", "1999010203", kind="text/dns")
    found = list(archives.arc_records(data))
    assert [b for _, b in found[1:]] == [body, b"", b"plain"] and found[0][0]["version"] == str(version)
    assert found[1][0]["URL"] == "http://a.b/x%20y"
    parsed = list(archives.warc_parsed(b"".join(archives.convert_arc(data, {2: "<urn:x>"}))))
    heads = [h for h, _ in parsed]
    assert [h["warc-type"] for h in heads] == ["warcinfo", "response", "resource", "revisit"]
    assert heads[1]["warc-date"] == "1999-01-02T03:04:06Z" and heads[1]["warc-ip-address"] == "1.2.3.4" and parsed[1][1] == body
    assert heads[1]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"payload\nURL IP\n").digest()).decode()
    assert heads[1]["warc-record-id"] == ("<urn:arc:old.arc:77>" if version == 2 else heads[1]["warc-record-id"]) and len({h["warc-record-id"] for h in heads}) == 4
    assert heads[3]["warc-refers-to"] == "<urn:x>"
    assert list(archives.arc_records(data[:-3]))[-1][1] == b""  # a record that is cut short ends the file


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/ \n", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (9, "u", big), (6, "", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 30)]
    frame = spark.createDataFrame([(*p, "own", "own") for p in pages], "page_id long, url string, html string, refers_to string, record_type string")
    archives.write(frame.drop("refers_to"), str(tmp_path / "w"))
    rows = archives.read(spark, str(tmp_path / "w")).collect()
    got = sorted((r["page_id"] or "", r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to_page"]) for r in rows)
    want = []
    for k, _, html in pages:
        raw = (html or "").encode()
        again = html == big and k not in (9, None)
        want.append((str(k or ""), "revisit" if again else "response", len(raw), hashlib.sha1(raw).hexdigest(), "9" if again else None))
    assert got == sorted(want, key=lambda x: x[:4]) and len({r["record_id"] for r in rows}) == len(pages)
    nine = {r["record_id"] for r in rows if r["page_id"] == "9"}
    assert {r["refers_to_id"] in nine for r in rows if r["record_type"] == "revisit"} == {True}
    assert {bytes(r["payload"]).decode() for r in rows if r["payload"] is not None} == {big, "small", "", pages[-1][2]}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_with_spaces_and_damage(version):
    record = lambda block, url, **more: archives.arc_record(version, block, "U", "19990102030406", **more).replace(b"U", url, 1)
    data = archives.arc_version_block(version, "old.arc", "19990102030405") + record(b"one", b"http://a/b c d", ip="1.2.3.4")
    data += record(b"two", b"http://a", kind="text/html; charset=x y") + record(b"three", b"http://a/ b", kind="a; b") + record(b"1 0 x\nURL\n", b"filedesc://b")
    data += b"a damaged line\n" + record(b"four", b"http://d") + record(b"x" * 10, b"http://e").replace(b" 10\n", b" 9999\n") + record(b"five", b"http://f")
    with pytest.warns(UserWarning, match="no whole ARC record"):
        found = list(archives.arc_records(data))[1:]
    assert [b for _, b in found] == [b"one", b"two", b"three", b"1 0 x\nURL\n", b"four", b"five"]
    assert [f["URL"] for f, _ in found] == ["http://a/b c d", "http://a", "http://a/ b", "filedesc://b", "http://d", "http://f"]
    assert [f["Content-type"] for f, _ in found[:3]] == ["text/html", "text/html; charset=x y", "a; b"] and found[0][0]["IP-address"] == "1.2.3.4"


def test_warc_keeps_pages_after_a_version_blocks_url(spark, tmp_path):
    pages = spark.createDataFrame([("a b", "filedesc://x", "1 0 x\nURL\n"), ("c", "u", "page"), ("d", "u", "last")], "page_id string, url string, html string").coalesce(1)
    archives.write(pages, str(tmp_path / "w"))
    rows = archives.read(spark, str(tmp_path / "w")).collect()
    assert sorted((r["page_id"], r["url"]) for r in rows) == [("a b", "filedesc://x"), ("c", "u"), ("d", "u")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_are_read_back_at_their_offsets(spark, tmp_path, version):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{k}é" * (k + 1)) for k in range(30)], "page_id long, url string, html string").repartition(3)
    archives.write_arc(pages, str(tmp_path / "arc"), version=version)
    files = [archives.inflated(f.read_bytes()) for f in (tmp_path / "arc").glob("*.gz")]
    assert len(files) >= 2 and all(f.startswith(b"filedesc://") for f in files)
    for data in files:
        for fields, _ in list(archives.arc_records(data))[1:]:
            if version == 2:
                assert data[int(fields["Offset"]) :].startswith(fields["URL"].encode() + b" ")
    rows = archives.read_arc(spark, str(tmp_path / "arc")).where("page is not null").collect()
    assert {(r["page"], payload.decode()) for r in rows for _, payload in [archives.payload_of(bytes(r["block"]))]} == {(str(k), f"<p>{k}é" * (k + 1)) for k in range(30)}
    assert archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc")) == 30
    assert archives.read(spark, str(tmp_path / "warc")).count() == 30


def test_archives_compressed_record_by_record():
    records = [archives.arc_version_block(1, "old.arc", "19990102030405"), *(archives.arc_record(1, b"block %d" % k, f"http://{k}", "19990102030406") for k in range(4))]
    packed = [gzip.compress(r) for r in records]
    assert list(archives.arc_records(archives.inflated(b"".join(packed)))) == list(archives.arc_records(b"".join(records)))
    assert archives.inflated(b"plain") == b"plain" and archives.inflated(b"") == b""
    with pytest.warns(UserWarning, match="damaged gzip member"):
        found = archives.inflated(packed[0] + packed[1] + packed[2][:-6] + packed[3] + packed[4])
    assert [f["URL"] for f, _ in archives.arc_records(found)][-2:] == ["http://2", "http://3"]


def test_damaged_warc_records_are_skipped():
    whole = [archives.warc_record({"URL": f"http://{k}", "IP-address": "-", "Archive-date": "1999", "Content-type": "a", "Archive-length": "3"}, b"abc") for k in range(3)]
    with pytest.warns(UserWarning, match="no whole WARC record"):
        found = list(archives.warc_parsed(whole[0] + whole[1].replace(b"Content-Length: 3", b"Content-Length: x") + whole[2] + b"WARC/1.1\r\ncut"))
    assert [h["warc-target-uri"] for h, _ in found] == ["http://0", "http://2"]


def test_warc_query(same):
    same(q.op3_warc, q.ORACLES["op3_warc"])


def test_warc_of_nothing(spark, tmp_path):
    archives.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert archives.read(spark, str(tmp_path / "w")).count() == 0


def test_pipeline_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(
        spark.createDataFrame([(None, "Nur ein Satz ohne Nummer", "de", "s", 24), (9001, None, "de", "s", 0), (9002, "12 34", "de", "s", 5), (9003, "Nur ein Satz ohne Nummer", "de", "s", 24)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "passages", "decontamination", "packing"]
    kept = stages["language"](spark, docs, small)
    assert kept.schema == docs.schema and kept.count() == docs.count() - 2
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    single = stages["near_duplicates"](spark, kept, small)
    groups = brute_groups([(1 << 70 if d is None else d, t) for d, t in rows])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({g for _, _, g in groups})
    cut = stages["passages"](spark, single, small)
    want = {d: (n, kept) for d, _, n, kept in brute_passages([tuple(r) for r in single.select("doc_id", "text").collect()])}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in cut.collect():
        n, digest = want[r["doc_id"]]
        assert r["text"] == before[r["doc_id"]] if not n else sha(r["text"].encode()) == digest
        assert r["n_chars"] == len(r["text"])
    assert cut.columns == docs.columns
    clean = stages["decontamination"](spark, cut, small)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {r["doc_id"]: brute_hits(r["text"], items) for r in cut.collect()}
    flagged = {d for d, (n, hit, _) in judged.items() if hit and 20 * hit >= n}
    assert clean.schema == cut.schema and flagged and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(judged) - flagged)
    packed = stages["packing"](spark, clean, small)
    model, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    for r in packed.orderBy("doc_id", "start").collect():
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got == {r["doc_id"]: [*model.encode(r["text"], add_special_tokens=False).ids, 1] for r in clean.collect()}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_of_nothing_and_of_a_very_long_text(spark, small, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert run(spark, spark.createDataFrame([], schema), small).count() == 0
    long = " ".join(f"w{k}" for k in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, "a b c d e", "en", "s", 9)], schema)
    out = run(spark, docs, small)
    if stage == "packing":
        ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = {d: len(ids.encode(t, add_special_tokens=False).ids) + 1 for d, t in ((1, long), (2, "a b c d e"))}
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += r["length"]
            assert r["doc_tokens"] == want[r["doc_id"]] and r["length"] <= 2048
        assert got == want
        return
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, long), (2, "a b c d e")}


def test_intermediates_are_deleted_when_results_are_written(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    began = common.written()
    with common.only_result(spark, began) as write:
        found = write(passages.remove_repeats(docs))
        made = list(common._written[began:])
        assert len(made) >= 3 and all(Path(re.sub("^file:/*", "/", p)).exists() for p in made)
    assert not any(Path(re.sub("^file:/*", "/", p)).exists() for p in made)
    assert found.count() == docs.count() and common.written() == began + 1
    common.forget(spark, began)


def test_pipeline_names_languages_that_rows_lack(spark, small):
    texts = {"de": "der Hund und die Katze schlafen nicht", "en": "the dog and the cat are not asleep"}
    rows = [(k, texts[lang], lang) for k in range(40) for lang in texts] + [(100, texts["de"], None), (101, texts["en"], None), (102, texts["en"], "de"), (103, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, small)
    assert {r["doc_id"]: r["lang"] for r in kept.where("doc_id >= 100").collect()} == {100: "de", 101: "en", 102: "de"}


def test_pipeline_runs(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_pipeline_keeps_clashing_columns(spark, small):
    docs = spark.createDataFrame([(k, t, "en", "s", 3, "own", "own", "own") for k, t in enumerate(["one two three", "vier fünf sechs", None])], "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, _at string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and {r["score"] for r in out.collect()} == {"own"}


def _asked(keys):
    """What an exchange would answer to the keys of each block."""
    a, b = np.concatenate([k.a for k in keys]), np.concatenate([k.b for k in keys])
    bits, ends = exchange.answers(a, b, None, False), np.cumsum([len(k.a) for k in keys])
    return [bits[:, e - len(k.a) : e] for e, k in zip(ends, keys, strict=True)]


def test_hashes_modulo_a_prime(monkeypatch):
    prime, root = int(suffixes.PRIME), suffixes._ROOT
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, prime, (2, 1000)).astype(np.uint64)
    a[:3] = b[:3] = (0, 1, prime - 1)
    assert suffixes.times(a, b).tolist() == [x * y % prime for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    monkeypatch.setattr(suffixes, "_ADDED", 64)  # as if sums were brought below the prime often
    text = bytes(rng.integers(0, 256, 20_000).astype(np.uint8))
    block = suffixes.Block([text], suffixes.Powers())
    start = np.array([0, 1, 5000, 17_000])
    got = block.prime_hashes(start, start + 300).tolist()
    assert got == [sum((c + 1) * pow(root, k, prime) for k, c in enumerate(text[s : s + 300])) % prime for s in start.tolist()]


def test_suffixes_of_many_small_corpora():
    powers = suffixes.Powers()
    for seed in range(40):
        rng = np.random.default_rng(seed)
        base = bytes(rng.integers(97, 97 + rng.integers(2, 6), 2500).astype(np.uint8))
        if seed % 4 == 0:  # periodic, so that the least hash stands at several places
            base = (base[: int(rng.integers(1, 60))] * 3000)[:2500]
        texts = []
        for _ in range(int(rng.integers(3, 25))):
            at = int(rng.integers(0, 2000))
            text = bytearray(base[at : at + int(rng.integers(180, 460))])
            for _ in range(int(rng.integers(0, 3))):
                text[rng.integers(0, len(text))] = 120
            ends = [bytes(rng.integers(65, 70, int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(2)]
            texts.append(ends[0] + bytes(text) + ends[1])
        n = int(rng.integers(1, 4))
        blocks = [suffixes.Block(texts[k::n], powers) for k in range(n)]
        first = _asked([b.contexts()[0] for b in blocks])
        then = _asked([b.suffixes(t)[2] for b, t in zip(blocks, first, strict=True)])
        got = Counter()
        for block, one, two in zip(blocks, first, then, strict=True):
            removed, spans, kept = block.kept(block.removed(one, two[0]))
            got.update(zip(map(len, block.texts), removed, spans, map(sha, kept), strict=True))
        assert got == Counter(brute_suffixes([t.decode() for t in texts]))


def test_workers_need_no_copy_of_the_package(small, tmp_path):
    """Only the driver can import the package; workers start in another folder."""
    root = str(Path(corpus_pipeline.__file__).resolve().parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
queries = __spark_entry__.queries()
for name in [n for n in queries if n.startswith("op") or n in ("pipeline", "maxmin_documents", "recursive_chunks", "html_elements", "topk_batch")]:
    queries[name](spark, {small!r}).write.format("noop").mode("overwrite").save()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or root not in v}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stderr[-3000:]


def test_large_cells_are_cut_by_bits(spark, monkeypatch):
    """Fingerprints that share 32 bits are joined in cells of bounded size."""
    monkeypatch.setattr(simhash, "MANY", 64)
    rng = np.random.default_rng(8)
    low = rng.integers(0, 1 << 32, 3000).astype(np.uint64)
    for k in range(300):
        low[k + 300] = low[k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(32, k % 7, replace=False)))
    prints = np.unique(np.uint64(0x5A5A5A5A << 32) | low)
    pairs = []
    for a in range(0, len(prints), 500):
        i, j = np.nonzero(np.bitwise_count(prints[a : a + 500, None] ^ prints[None, :]) <= 4)
        pairs += [(int(prints[a + x]), int(prints[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True) if a + x < y]
    frame = spark.createDataFrame([(int(p.astype(np.int64)),) for p in prints], "fingerprint long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    assert _roots(links, prints.tolist()) == _roots(pairs, prints.tolist())
    # a cell's pieces: each pair of near ones shares a cell, and cells are small
    cell, of, free = np.zeros(len(prints), np.int64), prints, np.full(len(prints), 0xFFFFFFFF, np.uint64)
    while True:
        cell, of, free = simhash.cut(cell, of, free)
        sizes = np.unique(cell, return_counts=True)[1]
        if sizes.max() <= simhash.MANY or np.bitwise_count(free).max() <= simhash.LAST:
            break
        large = np.isin(cell, np.unique(cell)[sizes > simhash.MANY])
        cell, of, free = cell[large], of[large], free[large]
    assert sizes.max() <= simhash.MANY


def test_pieces_cover_all_free_bits():
    for free in (0xFFFFFFFFFFFFFFFF, 0xFFFFFFFF, 0b1011011101111, 0b101):
        parts = simhash.pieces(free)
        assert len(parts) == 5 and sum(parts) == free and max(p.bit_count() for p in parts) - min(p.bit_count() for p in parts) <= 1


def test_splitters_follow_the_number_of_buckets(spark, monkeypatch):
    """With more buckets than the first sample has suffixes for, cuts come from a larger one, and buckets stay even."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [line(45) for _ in range(120)]
    docs = spark.createDataFrame([(k, " ".join([line(30), *rnd.sample(shared, 3), line(30)])) for k in range(150)], "doc_id long, text string").repartition(4)
    want = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffixes.remove_repeats(docs).collect())
    made = []
    own = suffixes._cuts
    monkeypatch.setattr(suffixes, "_cuts", lambda *a: made.append(own(*a)) or made[-1])
    for name, value in (("SAMPLED", 1), ("EACH", 64)):
        monkeypatch.setattr(suffixes, name, value)
    for name, value in (("BLOCK", 20_000), ("KEYS", 500), ("MESSAGE", 0)):
        monkeypatch.setattr(exchange, name, value)
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffixes.remove_repeats(docs).collect()) == want
    assert made and len(made[0]) > 3 and [tuple(x) for x in made[0].tolist()] == sorted(tuple(x) for x in made[0].tolist())


def test_cuts_are_quantiles(spark):
    rng = np.random.default_rng(3)
    blocks = [(int(n), np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2)), rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2)) for n in (400, 4000, 40)]
    frame = spark.createDataFrame([(n, bytearray(a.tobytes()), bytearray(b.tobytes())) for n, a, b in blocks], "n long, a binary, b binary")
    rows = sorted((x, y, n / 40) for n, a, b in blocks for x, y in zip(a.tolist(), b.tolist(), strict=True))
    total, run, want = sum(w for *_, w in rows), 0.0, []
    for x, y, w in rows:
        if int((run + w) * 8 / total) > int(run * 8 / total + 1e-12) and (run + w) * 8 / total < 8:
            want.append((x, y))
        run += w
    assert [tuple(r) for r in suffixes._cuts(frame, 8).tolist()] == want
