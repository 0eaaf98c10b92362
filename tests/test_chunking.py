import math
import re
import time
import zlib
from collections import deque
from functools import reduce
from operator import add

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave.functions import vectors
from folioweave.functions.cleaning import clean_text
from folioweave.operators import elements, embed, maxmin, recursive, sentences
from folioweave.sources.sinks import arrays_json

ESCAPED = ["\\\n\\\n", "\\\n", "\\ ", ""]


def split(text, size, overlap, separators=ESCAPED):
    return recursive.split_text(text, size, overlap, separators, len)


def test_windows_of_characters():
    assert split("abcdefghij", 4, 1, [""]) == ["abcd", "defg", "ghij"]
    assert split("abc", 1000, 200) == ["abc"]
    assert split("", 10, 2) == []


def test_separators_are_tried_in_turn():
    assert split("aa bb\n\ncc dd", 8, 0) == ["aa bb", "cc dd"]
    assert split("aa bb\n\ncc dd", 5, 0) == ["aa bb", "cc", "dd"]
    assert split("one two three four", 9, 4) == ["one two", "three", "four"]
    assert split("a b c d e", 5, 3) == ["a b c", "c d", "d e"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 20), st.integers(0, 20))
def test_chunks_are_bounded_and_keep_every_word_character(text, size, overlap):
    overlap = min(overlap, size)
    chunks = split(text, size, overlap)
    assert all(0 < len(c) <= size and (size == 1 or c == c.strip()) for c in chunks)
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def naive_split(text, size, overlap, separators):
    """The published contract of a recursive splitter, said as plainly as can be: separators are plain texts, kept in front of what follows."""
    separator = next((s for s in separators if s in text), separators[-1])
    finer = separators[separators.index(separator) + 1 :]
    pieces, rest = ([], text) if separator else (list(text), "")
    while rest:  # a separator that overlaps itself counts at its leftmost places
        own = len(separator) if rest.startswith(separator) else 0
        at = rest.find(separator, own)
        at = at if at >= 0 else len(rest)
        pieces.append(rest[:at])
        rest = rest[at:]
    groups, out = [[]], []
    for piece in pieces:
        if len(piece) < size:
            groups[-1].append(piece)
        else:
            groups += [piece, []]
    for group in groups:
        if isinstance(group, str):
            out += naive_split(group, size, overlap, finer) if finer else [group]
            continue
        window = deque()
        for piece in [*group, None]:
            if piece is None or (window and sum(map(len, window)) + len(piece) > size):
                out += [c] if (c := "".join(window).strip()) else []
                while piece is not None and window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                    window.popleft()
            window.append(piece)
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 20), st.integers(0, 20))
def test_chunks_are_those_of_a_naive_splitter(text, size, overlap):
    overlap = min(overlap, size)
    assert split(text, size, overlap) == naive_split(text, size, overlap, ["\n\n", "\n", " ", ""])


def test_overlap_larger_than_chunks_fails(spark):
    rows = spark.createDataFrame([("abc",)], "text string")
    assert rows.select(recursive.split(F.col("text"), chunk_size=3, chunk_overlap=4)).first()[0] is None
    assert rows.select(recursive.windows(F.col("text"), chunk_size=3, chunk_overlap=4)).first()[0] is None


def test_windows_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",)], "text string")
    assert [r[0] for r in rows.select(recursive.windows(F.col("text"))).collect()] == [None, [], []]


def test_sentences(spark):
    rows = spark.createDataFrame([("Ini kalimat pertama. Ini kalimat kedua. Ini kalimat ketiga.",), (" ",), (None,)], "text string")
    got = [r[0] for r in rows.select(sentences.split_sentences(F.col("text"))).collect()]
    assert got == [["Ini kalimat pertama.", "Ini kalimat kedua.", "Ini kalimat ketiga."], [], None]


def _angles(*degrees):
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]


@pytest.mark.parametrize(("degrees", "want"), [((), []), ((0,), [0]), ((0, 60), [0]), ((0, 70), [0, 1]), ((0, 30, 60, 120), [0, 3]), ((0, 5, 10, 55), [0, 3])])
def test_maxmin_vectors(spark, degrees, want):
    rows = spark.createDataFrame([(1, _angles(*degrees))], "id int, v array<array<double>>")
    for impl in ("arrow", "hof"):
        assert maxmin.cluster(rows, "v", impl=impl).first()["starts"] == want


def test_maxmin_chunks(spark):
    rows = spark.createDataFrame([("d", ["a.", "b.", "c."], [0, 2]), ("e", [], [])], "source string, s array<string>, starts array<int>")
    got = maxmin.to_chunks(rows, "s", "starts", "source").orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["text"], r["num_sentences"], r["metadata"]["num_characters"]) for r in got] == [(0, "a. b.", 2, 5), (1, "c.", 1, 2)]


def test_embeddings_have_length_one(spark):
    rows = spark.createDataFrame([(["ab cd", "", "x"],), ([],), (None,)], "s array<string>")
    got = [r[0] for r in embed.embed(rows, "s", "v").select("v").collect()]
    assert [round(float(np.linalg.norm(v)), 5) for v in got[0]] == [1.0, 0.0, 1.0]
    assert got[1:] == [[], None]


def test_a_norm_is_computed_once(spark):
    rows = spark.range(50).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: x.cast("double")).alias("v"))
    unit = rows.select(vectors.l2_normalize(F.col("v")).alias("u"))
    began = time.perf_counter()
    got = unit.select(F.round(vectors.norm(F.col("u")), 9).alias("n")).distinct().collect()
    assert [r["n"] for r in got] == [1.0] and time.perf_counter() - began < 30  # 50 x 4000 x 4000 products would take minutes


def test_embedding_and_folding_in_one_pass(spark):
    rows = spark.createDataFrame([(["ab cd ef", "ab cd eg", "xyz"],), ([],), (None,)], "s array<string>")
    both = maxmin.cluster(embed.embed(rows, "s", "v"), "v").select("starts").collect()
    assert maxmin.embed_and_cluster(rows, "s").select("starts").collect() == both and both[1:] == [([],), (None,)]


def test_elements_keep_gaps(spark):
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><h1>A</h1><hr><p> B <b>c</b></p><ul><li>d<li>e</ul><table><tr><td>1</td><td>2</td></tr></table>tail</body>"
    rows = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    found = elements.partition(rows, "html", "url")
    got = elements.to_chunks(found, "url").orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["metadata"]["element_type"], r["text"]) for r in got] == [
        (0, "Title", "A"),
        (2, "NarrativeText", "B c"),
        (3, "ListItem", "d"),
        (4, "ListItem", "e"),
        (5, "Table", "1 2"),
        (6, "UncategorizedText", "tail"),
    ]
    assert got[4]["metadata"]["text_as_html"] == "<table><tr><td>1</td><td>2</td></tr></table>"
    assert "no content" in found.where("url = 'v'").first()["error"]
    assert "metadata" not in elements.to_chunks(found, "url", include_metadata=False).columns


def test_clean_then_chunk_plans_one_python_step(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = docs.select(recursive.split(clean_text(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "ArrowEvalPython" in plan


def test_chunks_are_computed_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("chunks", recursive.split(clean_text(F.col("text"))))
    plan = recursive.to_chunks(docs, "chunks", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_ties_with_the_limit_are_those_of_plain_sums():
    """A similarity of exactly 0.4 times 1.5 is no more than 0.6 by sums in order; other orders of summing say otherwise."""
    dot = lambda a, b: reduce(add, (x * y for x, y in zip(a, b, strict=True)), 0.0)
    plain = lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))
    rnd = np.random.default_rng(1)
    for _ in range(200):
        rows = rnd.integers(-2, 3, size=(2, 64)).astype(float)
        rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32).astype(float)
        near = plain(rows[0].tolist(), rows[1].tolist())
        if near > 0.01:
            assert maxmin.starts_of(rows, 1.5 * near) == [0, 1]
            assert maxmin.starts_of(rows, np.nextafter(1.5 * near, 0)) == [0]


def test_long_clusters_look_at_the_latest_first(monkeypatch):
    rnd = np.random.default_rng(2)
    rows = rnd.normal(size=(400, 8))

    def naive(vectors, floor):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        starts, low = [0], np.inf
        for i in range(1, len(unit)):
            near = unit[starts[-1] : i] @ unit[i]
            alone = len(near) == 1
            limit, reach = (0.0, 1.5 * near[0]) if alone else (low * 0.9 / (1 + math.exp(1 - len(near))), near.max())
            low = min(low, near.min())
            if not reach > max(limit, floor):
                starts, low = [*starts, i], np.inf
        return starts

    looked = []
    for latest in (1, 5, 64):
        monkeypatch.setattr(maxmin, "LATEST", latest)
        for floor in (-1.0, 0.05, 0.6, 0.9):
            assert maxmin.starts_of(rows, floor) == naive(rows, floor)
            looked.append(floor)
    assert len(looked) == 12


def test_hash_embedder_sums_words(monkeypatch):
    texts = ["Kata kata buku", "", "  ", "buku é😀 x", *(f"w{k} kata" for k in range(40))]
    want = []
    for text in texts:
        v = [0] * 64
        for word in text.lower().split():
            marked = f"<{word}>"
            for part in (marked, *(marked[i : i + 3] for i in range(len(marked) - 2))):
                h = zlib.crc32(part.encode())
                v[(h >> 1) % 64] += 1 - 2 * (h & 1)
        want.append(v)
    monkeypatch.setattr(embed.HashEmbedder, "REMEMBERED", 9)
    model = embed.HashEmbedder()
    assert np.concatenate([model.embed(texts[a : a + 5]) for a in range(0, len(texts), 5)]).tolist() == want


@pytest.mark.parametrize("latest", [3, 64])
def test_built_in_fold_of_long_clusters(spark, monkeypatch, latest):
    monkeypatch.setattr(maxmin, "LATEST", latest)
    rows = np.random.default_rng(3).normal(size=(150, 8))
    docs = spark.createDataFrame([(rows.tolist(),)], "v array<array<double>>")
    for floor in (-1.0, 0.05, 0.6, 0.9):
        found = maxmin.cluster(docs, "v", fixed_threshold=floor, impl="hof")
        assert found.first()["starts"] == maxmin.starts_of(rows, floor)
    assert "exists(" in found._jdf.queryExecution().toString()


def test_one_empty_separator_needs_no_python(spark):
    texts = [None, "", " x ", "é😀 " * 900, "a" * 2500]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for size, overlap in ((1000, 200), (7, 0), (5, 4)):
        found = docs.select("text", recursive.split(F.col("text"), chunk_size=size, chunk_overlap=overlap, separators=[""]).alias("c"))
        assert [r["c"] for r in found.collect()] == [None if t is None else split(t, size, overlap, [""]) for t in texts]
        assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    same = docs.select(recursive.split(F.col("text"), chunk_size=3, chunk_overlap=3, separators=[""]).alias("c"))
    assert same.collect()[4]["c"] == split("a" * 2500, 3, 3, [""])


def test_chunks_are_made_once(spark):
    """A filter on the chunks' number must not have Python make them again."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "kata " * 900, *["x y " * 400] * 40])], "doc_id long, text string")
    made = docs.withColumn("chunks", recursive.split(F.col("text")))
    found = arrays_json(made, "doc_id", recursive.structs(F.col("chunks"), F.col("doc_id")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert len(found.collect()) == 41
    assert [r["chunks"] for r in made.orderBy("doc_id").collect()] == [None if r["text"] is None else split(r["text"], 1000, 200) for r in docs.orderBy("doc_id").collect()]
