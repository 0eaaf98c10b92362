"""Listing, caches, routes, reading order, jobs that use them, and streams with state."""

import os
import random
import sys
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioweave.operators import elements, layout
from folioweave.operators.cache import Cache, embed_cached
from folioweave.plans import cli, jobs
from folioweave.sources import files, listing, sinks
from folioweave.streaming import arriving, current

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_listing_is_made_by_tasks(spark, tmp_path):
    for name, data in (("a [1]*?.txt", b"x"), ("empty.txt", b""), ("b.TXT", b"y"), ("é.txt", "é".encode())):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub.txt").mkdir()
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        assert listing.readable(path)
        rows = listing.contents(listing.listed(spark, path, "*.txt")).collect()
        assert {(r["source_file"], r["length"], bytes(r["content"]), r["error"]) for r in rows} == {("a [1]*?.txt", 1, b"x", None), ("empty.txt", 0, b"", None), ("é.txt", 2, "é".encode(), None)}
        assert all(abs(r["modificationTime"].timestamp() - os.path.getmtime(tmp_path / r["source_file"])) < 1 for r in rows)
    assert listing.listed(spark, str(tmp_path / "none")).collect() == [] and not listing.readable("viewfs://store/in")
    found = listing.listed(spark, str(tmp_path), "*.txt").persist()
    found.count()
    (tmp_path / "empty.txt").unlink()
    gone = {r["source_file"]: r["error"] for r in listing.contents(found).collect()}
    found.unpersist()
    assert gone["empty.txt"].startswith("FileNotFoundError") and gone["é.txt"] is None
    assert listing.contents(listing.listed(spark, str(tmp_path)).where("false")).collect() == []


def test_listing_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "LISTED", 7)
    monkeypatch.setattr(listing, "BATCH", 20)
    for k in range(60):
        (tmp_path / f"{k}.txt").write_text("t" * (k % 9))
    found = listing.contents(listing.listed(spark, str(tmp_path)))
    assert {(r["source_file"], bytes(r["content"])) for r in found.collect()} == {(f"{k}.txt", b"t" * (k % 9)) for k in range(60)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "0.txt" not in plan


CALLS = "calls"


def counting(folder):
    """A model that leaves a file for each text that it is asked for."""

    def load():
        def embed(texts):
            for t in texts:
                (folder / f"{abs(hash(t))}-{random.getrandbits(60)}").write_text(t)
            return np.array([[len(t), 1.0] for t in texts])

        return embed

    return load


def test_embeddings_are_made_once(spark, tmp_path):
    calls = tmp_path / CALLS
    calls.mkdir()
    seen = lambda: Counter(f.read_text() for f in calls.iterdir())
    rows = [(1, ["a b", "c"]), (1, ["a b", "c"]), (2, None), (3, []), (None, ["c", None, "", "a b", "c"])] + [(k, ["everywhere"]) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "id long, s array<string>").withColumns({"hash": F.lit("own"), "vector": F.lit("own"), "places": F.lit("own")})
    cache = Cache(spark, str(tmp_path / "cache"), "model/é 1")
    for _ in range(2):
        found = embed_cached(docs, "s", cache=cache, embedder=counting(calls), normalize=False)
        got = sorted(((r["id"], r["s"], r["embeddings"]) for r in found.collect()), key=repr)
        assert got == sorted(((d, s, None if s is None else [None if t is None else [len(t), 1.0] for t in s]) for d, s in rows), key=repr)
        assert seen() == {"a b": 1, "c": 1, "": 1, "everywhere": 1}
    more = spark.createDataFrame([(9, ["a b", "new"])], "id long, s array<string>")
    assert embed_cached(more, "s", cache=cache, embedder=counting(calls), normalize=False).count() == 1 and seen()["new"] == 1 and seen()["a b"] == 1
    assert embed_cached(more, "s", cache=Cache(spark, str(tmp_path / "cache"), "other"), embedder=counting(calls)).count() == 1 and seen()["a b"] == 2
    assert embed_cached(docs.where("false"), "s", cache=cache, embedder=None).collect() == []


def test_a_sentence_that_most_documents_hold_is_broadcast(spark, tmp_path, monkeypatch):
    from folioweave.operators import cache as module

    monkeypatch.setattr(module, "HOT_PLACES", 10)
    docs = spark.createDataFrame([(k, ["everywhere", f"own {k}", None]) for k in range(600)], "id long, s array<string>")
    held = Cache(spark, str(tmp_path / "cache"), "m")
    found = embed_cached(docs, "s", cache=held, embedder=lambda: lambda texts: np.array([[len(t), 0.0] for t in texts]), normalize=False)
    assert "everywhere" not in found._jdf.queryExecution().toString()
    assert all(r["embeddings"] == [[10.0, 0.0], [float(len(r["s"][1])), 0.0], None] for r in found.collect()) and held.read().count() == 601


def test_vectors_cross_shuffles_packed(spark, tmp_path):
    docs = spark.createDataFrame([(k, [f"own {k}", "b"]) for k in range(30)], "id long, s array<string>")
    held = Cache(spark, str(tmp_path / "cache"), "m")
    found = embed_cached(docs, "s", cache=held, embedder=lambda: lambda texts: np.array([[len(t), 0.1] for t in texts]), normalize=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and not any("vector" in line for line in plan.splitlines() if "Exchange" in line)
    assert "vector" not in spark.read.parquet(held.path).columns
    assert sorted(found.collect()) == sorted((r["id"], r["s"], [[float(len(t)), float(np.float32(0.1))] for t in r["s"]]) for r in docs.collect())


def test_entries_of_earlier_versions_are_read(spark, tmp_path):
    held = Cache(spark, str(tmp_path / "cache"), "m")
    spark.createDataFrame([("a",), ("b",)], "s string").select(F.sha2("s", 256).alias("hash"), F.array(F.lit(0.5), F.lit(-2.0)).cast("array<float>").alias("vector")).write.parquet(held.path)
    docs = spark.createDataFrame([(["b", "c", "a"],)], "s array<string>")
    found = embed_cached(docs, "s", cache=held, embedder=lambda: lambda texts: np.array([[7.0, 1.0] for t in texts if t == "c"]), normalize=False)
    assert found.first()["embeddings"] == [[0.5, -2.0], [7.0, 1.0], [0.5, -2.0]]
    assert sorted(r["vector"] for r in held.read().collect()) == [[0.5, -2.0], [0.5, -2.0], [7.0, 1.0]]


def fast(content):
    return iter([("NarrativeText", "fast", None)])


def slow(content):
    if b"bad" in content:
        raise ValueError("no layout")
    return iter([("Title", "slow", None), ("NarrativeText", f"{len(content)}", None)])


def share(content):
    if not content:
        raise ValueError("empty")
    return content.count(b"t") / len(content)


def test_each_document_goes_to_the_strategy_that_its_text_asks_for(spark, tmp_path):
    rows = [("a", b"ttt"), ("b", b"tx"), ("c", b"x"), ("d", None), ("e", b""), ("f", b"bad!bad!")]
    docs = spark.createDataFrame(rows, "name string, content binary").withColumn("strategy", F.lit("own"))
    found = {r["name"]: r for r in elements.route(docs, "content", "name", share, {"fast": (0.5, fast), "slow": (0.1, slow)}).collect()}
    assert {n: (r["strategy"], None if r["elements"] is None else r["elements"][0]["text"]) for n, r in found.items()} == {"a": ("fast", "fast"), "b": ("fast", "fast"), "c": (None, None), "d": (None, None), "e": (None, None), "f": (None, None)}
    assert [found[n]["error"] for n in "cdef"] == ["ValueError: no strategy takes it", "ValueError: no content", "ValueError: empty", "ValueError: no strategy takes it"]
    found = {r["name"]: (r["strategy"], r["error"]) for r in elements.route(docs, "content", "name", share, {"fast": (0.5, fast), "slow": (0.0, slow)}).collect()}
    assert found["c"] == ("slow", None) and found["f"] == ("slow", "ValueError: no layout") and found["a"] == ("fast", None)
    measure = elements.by_pages(lambda c: (c.decode().split("\f"), {}), 3)
    assert [measure(x) for x in (b"abc\fa b", b"abcd", b" ", b"")] == [0.5, 1.0, 0.0, 0.0]
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in rows:
        (folder / f"{name}.pdf").write_bytes(data or b"")
    stats = jobs.chunk_elements(spark, str(folder), str(tmp_path / "out"), pattern="*.pdf", strategy="auto", measure=share, partitioners={"fast": (0.5, fast), "slow": (0.0, slow)}).first()
    assert (stats["processed"], stats["failed"], stats["total_chunks"]) == (3, 3, 4)
    a = cli.parser().parse_args(["element", "--strategy", "auto", "--measure", "m:f", "--route", "fast", "0.5", "m:g"])
    assert a.route == [["fast", "0.5", "m:g"]]


def naive_cut(boxes, which):
    """The same rule, every line between boxes tried."""
    if len(which) < 2:
        return which
    found = []
    for axis in (1, 0):
        for k in which:
            cut = boxes[k][axis + 2]
            below, above = [j for j in which if boxes[j][axis] <= cut], [j for j in which if boxes[j][axis] > cut]
            if above and all(boxes[j][axis + 2] <= cut for j in below):
                found.append((-(min(boxes[j][axis] for j in above) - cut), -axis, cut, below, above))
    if not found:
        return sorted(which, key=lambda k: (boxes[k][1], boxes[k][0]))
    *_, below, above = min(found)
    return naive_cut(boxes, below) + naive_cut(boxes, above)


@pytest.mark.parametrize("seed", range(6))
def test_reading_order_is_that_of_a_naive_version(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        corners = [(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(rnd.randint(0, 14))]
        boxes = [(x, y, x + rnd.randint(0, 6), y + rnd.randint(0, 6)) for x, y in corners]
        assert layout.xy_cut(boxes) == naive_cut(boxes, list(range(len(boxes))))


def test_columns_are_read_one_after_the_other(spark):
    page = lambda p: [(p, "head", 0, 0, 100, 8), (p, "r1", 55, 20, 100, 28), (p, "l1", 0, 20, 45, 28), (p, "r2", 55, 30, 100, 38), (p, "l2", 45, 38, 0, 30), (p, "foot", 0, 60, 100, 66)]
    kind = "array<struct<page_number:int,name:string,x0:double,y0:double,x1:double,y1:double>>"
    rows = [(1, [tuple(float(v) if isinstance(v, int) and i > 1 else v for i, v in enumerate(b)) for b in page(2) + page(1)]), (2, None), (3, []), (4, [(None, "a", 0.0, 0.0, 1.0, 1.0), (1, "b", None, 0.0, 1.0, 1.0), (1, "nan", float("nan"), 0.0, 1.0, 1.0), (1, "c", 5.0, 5.0, 6.0, 6.0)])]
    docs = spark.createDataFrame(rows, f"id long, e {kind}")
    found = {r["id"]: None if r["e"] is None else [x["name"] for x in r["e"]] for r in layout.in_reading_order(docs, "e").collect()}
    assert found == {1: ["head", "l1", "l2", "r1", "r2", "foot"] * 2, 2: None, 3: [], 4: ["a", "c", "b", "nan"]}


def test_sizes_and_sentences_of_jobs(spark, tmp_path):
    raw, out, log = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "log")
    raw.mkdir()
    (raw / "a.pdf").write_bytes(b"Satu   dua.")
    jobs.preprocess(spark, str(raw), out, extractor=lambda c: ([c.decode()], {}), log_dir=log)
    assert [tuple(r)[2:] for r in jobs.document_sizes(spark, out).collect()] == [(11, 9, None)]
    assert "a.pdf: 11 characters, 9 left (18.18 % less)" in {r["message"] for r in files.read_log(spark, log).collect()}
    texts = tmp_path / "texts"
    texts.mkdir()
    learnt = ["Semua orang pergi. Lihat no. 3 saja. Rumah itu besar, dll. yang lain kecil. Kata dr. Budi itu benar."] * 30
    (texts / "a.txt").write_text("\n".join(learnt))
    (texts / "b.txt").write_text("Lihat No. 5 hari ini. Kata Dr. Ali benar.")
    calls = tmp_path / CALLS
    calls.mkdir()
    cache = Cache(spark, str(tmp_path / "cache"), "m")
    for name, options in (("learnt", {"cache": cache}), ("again", {"cache": cache, "learn_from": str(texts)}), ("pattern", {"sentences": "pattern"})):
        jobs.chunk_maxmin(spark, str(texts), str(tmp_path / name), embedder=counting(calls), **options)
        sentences = {s for r in spark.read.parquet(str(tmp_path / name)).where("source_file = 'b.txt'").collect() for s in r["metadata"]["sentences"]}
        assert sentences == ({"Lihat No. 5 hari ini.", "Kata Dr. Ali benar."} if name != "pattern" else {"Lihat No.", "5 hari ini.", "Kata Dr.", "Ali benar."})
    assert Counter(f.read_text() for f in calls.iterdir())["Kata Dr. Ali benar."] == 1
    assert [(r["characters"], r["written"], r["chunks"] > 0) for r in jobs.document_sizes(spark, str(tmp_path / "pattern")).where("source_file = 'b.txt'").collect()] == [(41, None, True)]


def test_json_of_arrays_is_that_of_rows(spark):
    from folioweave.operators import recursive

    docs = spark.createDataFrame([(1, ["a", None, "é"]), (2, []), (3, None)], "id long, chunks array<string>")
    for metadata in (True, False):
        one = sinks.arrays_json(docs, "id", recursive.structs(F.col("chunks"), F.col("id"), metadata))
        two = sinks.chunks_json(recursive.to_chunks(docs, "chunks", "id", metadata), "id")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_tables_keep_what_cells_are(spark):
    found = list(elements.html_partitioner('<table class="x"><tr><td colspan="2" style="y">a</td><th scope=col hidden>b &amp; c</th></tr></table>'))
    assert found == [("Table", "a b & c", '<table><tr><td colspan="2">a</td><th scope="col">b & c</th></tr></table>')]


def _deliver(folder, day, minute, **content):
    at = folder / day
    at.mkdir(exist_ok=True)
    for name, text in content.items():
        (at / f"{name}.txt").write_text(text)
        t = (datetime(2024, 1, 1) + timedelta(minutes=minute)).timestamp()
        os.utime(at / f"{name}.txt", (t, t))


def test_files_that_arrive_again_replace_their_chunks(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def run():
        current.write(current.clean_and_chunk(current.changed(arriving.arriving_texts(spark, f"{inbox}/*"))), out, state).awaitTermination(180)
        rows = current.current(spark, out).collect()
        return {(r["source_file"], r["version"], r["text"]) for r in rows}

    _deliver(inbox, "d1", 10, a="Satu.", b="Dua.")
    assert run() == {("a.txt", 1, "Satu."), ("b.txt", 1, "Dua.")}
    _deliver(inbox, "d2", 20, a="Satu.", b="Dua baru.")  # seen again, and changed
    assert run() == {("a.txt", 1, "Satu."), ("b.txt", 2, "Dua baru.")}
    _deliver(inbox, "d3", 5, b="Lama.", c="Tiga.")  # late: older than what is there
    assert run() == {("a.txt", 1, "Satu."), ("b.txt", 2, "Dua baru."), ("c.txt", 1, "Tiga.")}
    _deliver(inbox, "d4", 30, a=" ")  # blank now
    _deliver(inbox, "d5", 40, c="Empat.")
    _deliver(inbox, "d6", 35, c="Antara.")  # in one batch the newest decides
    assert run() == {("b.txt", 2, "Dua baru."), ("c.txt", 2, "Empat.")}
    assert run() == {("b.txt", 2, "Dua baru."), ("c.txt", 2, "Empat.")}
    assert spark.read.parquet(out).count() == 6


def test_windows_of_arriving_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run(make, name):
        out = {}

        def put(batch, number):
            for r in batch.collect():
                out[tuple(str(x) for x in r[:-1])] = r[-1]

        q = make(arriving.arriving_texts(spark, f"{inbox}/*", files_per_batch=1)).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return out

    for k, minute in enumerate((0, 5, 50, 300, 20, 600)):  # the fifth comes when its hour is over
        _deliver(inbox, f"d{k}", minute, **{"a" if k % 2 == 0 else "b": str(k)})
        os.utime(inbox / f"d{k}", (k, k))
    by_hour = run(lambda t: arriving.per_interval(t, interval="1 hour", late="1 minute"), "hours")
    assert sum(by_hour.values()) in (4, 5) and all("2024" in k[0] for k in by_hour)
    by_session = run(lambda t: current.sessions(t, gap="30 minutes", late="1 minute"), "sessions")
    assert all(n >= 1 for n in by_session.values()) and {k[0] for k in by_session} <= {"a.txt", "b.txt"}
