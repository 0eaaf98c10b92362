"""Operators that look at one text at a time."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioweave.llm import decontaminate, language, packing, tokens, toxicity
from folioweave.llm import queries as q
from folioweave.llm.common import lookup, materialise

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"ab Z1,.'!?\n\n  é\t\xa0 ñß9中\xad<|s▁", "<|endoftext|>", "'s", "'ll", " \n", "\r\n", "\x1c", "​", "👍🏽", "<s>", "<unk>", "\n\n", "   "]


def fuzz(n=4000, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_token_counts_are_the_tokenizers(spark, small, awkward):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for found in (awkward, spark.createDataFrame(list(enumerate(fuzz())), "doc_id long, text string"), spark.read.parquet(f"{small}/documents.parquet")):
        rows = found.select("doc_id", "text").collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in rows)
        got = tokens.count_tokens(found.select("doc_id", "text"), PIECES)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens").collect()) == want
    assert "score" in tokens.count_tokens(awkward, PIECES).columns


def test_token_counts_without_a_hot_dictionary(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, tokens.count_tokens(docs, PIECES).collect()))
    for hot in (0, 300):
        monkeypatch.setattr(tokens, "HOT", hot)
        assert sorted(map(tuple, tokens.count_tokens(docs, PIECES).collect())) == want


def test_token_counts_of_nothing(nothing):
    assert tokens.count_tokens(nothing, PIECES).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    encoder, model = packing.Encoder(BYTES), Tokenizer.from_file(BYTES)
    assert encoder.merge
    texts = fuzz(20_000) + ["don't we'll x's", "Word,word. wörd ÀÉ", "a\n\n  b", " lead", "trail "]
    for e, ids in zip(model.encode_batch(texts, add_special_tokens=False), encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == e.ids


def _pieces(docs):
    return sorted(docs.collect(), key=lambda r: (r["sequence_id"], r["offset"]))


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_is_gapless_and_whole(spark, awkward, length):
    model = Tokenizer.from_file(BYTES)
    docs = awkward.withColumn("row", F.monotonically_increasing_id())
    pieces = _pieces(packing.pack(docs.select("doc_id", "text", "row", "score"), BYTES, length=length))
    at = 0
    for p in pieces:
        assert p["sequence_id"] * length + p["offset"] == at and 0 < p["length"] <= length - p["offset"]
        at += p["length"]
    for r in docs.collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p["row"] == r["row"]), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids) == own[0]["doc_tokens"]
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert bytes(p["ids"]) == part and p["ids_crc32"] == zlib.crc32(part)


def test_packing_query(spark, small):
    rows = q.op6_packing(spark, small).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing.select("doc_id", "text"), BYTES).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute_hits(text, items):
    words = WORD.findall(_lower(text or ""))
    hit, named = set(), set()
    for item, t in items:
        own = WORD.findall(_lower(t or ""))
        for i in range(max(1, len(own) - 12) if own else 0):
            w = own[i : i + 13]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    named |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("limit", [decontaminate.PASS, 100])
def test_decontamination_against_brute_force(spark, awkward, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PASS", limit)
    rnd = random.Random(1)
    vocabulary = ["a", "b", "é", "C3", "dd"]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(n))) for k, n in enumerate((3, 5, 14, 20, 30))] + [(10, None), (11, "--"), (None, "dd dd dd"), (3, "b a")]
    texts = [" ".join([*line(30), *WORD.findall(t or "")[: rnd.randint(0, 40)], *line(5)]).replace(" ", rnd.choice([" ", ", ", "\n--"])) for _, t in items * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(awkward.select("doc_id", "text").where(F.length("text").isNull() | (F.length("text") < 1000)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judged(decontaminate.find(docs, decontaminate.benchmark_items(benchmark)))
    for r in found.collect():
        n, hit, named = brute_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(named))
        assert r["items_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        raw = (r["text"] or "").encode()
        spans = [raw[a:b].decode() for a, b in zip(r["byte_from"], r["byte_to"], strict=True)]
        assert sum(len(WORD.findall(_lower(s))) for s in spans) == hit


def test_decontamination_cases(spark, awkward, nothing):
    found = decontaminate.find(awkward, [])
    assert found.count() == 11 and found.where("n_words > 0 and size(items) > 0").count() == 0
    assert dict(found.dtypes)["n_words"] == "bigint" and dict(found.dtypes)["score"] == "string"
    assert decontaminate.find(nothing, [[("1", b"a b")]]).count() == 0


def test_decontamination_of_many_small_texts():
    for seed in range(60):
        rnd = random.Random(seed)
        vocabulary = [f"w{k}" for k in range(rnd.choice([2, 3, 40]))]
        line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
        items = [(str(k), line(rnd.randint(1, 40))) for k in range(rnd.randint(1, 8))]
        windows = decontaminate.Windows([(k, " ".join(w).encode()) for k, w in items])
        found = windows.automaton()
        for _ in range(10):
            own = rnd.choice(items)[1]
            a = rnd.randrange(len(own))
            words = line(rnd.randint(0, 20)) + own[a : a + rnd.randint(1, 40)] + line(rnd.randint(0, 20))
            n, runs, named, _ = decontaminate.scan(windows, found, " ".join(words).encode())
            assert (n, sum(b - a for a, b in runs), sorted(named)) == brute_hits(" ".join(words), [(k, " ".join(w)) for k, w in items])


def test_decontamination_query(same):
    same(q.op5_decontaminate, q.ORACLES["op5_decontaminate"])


def test_languages_are_told_apart(spark, small):
    rows = q.op7_language(spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_profiles_are_bundles_of_bound_trigrams():
    p = language.Profiler(64)
    slot = {" ": 0, **{c: ord(c) - 96 for c in "ab"}}
    vector = lambda gram: np.prod([p.rolled[k][slot[c]] for k, c in enumerate(gram)], axis=0)
    got, lettered = p.vectors([b"Ab, b", b"1", b"", b"ab" * 9000])
    assert np.array_equal(got[0], vector(" ab") + vector("ab ") + vector(" b ")) and lettered.tolist() == [True, False, False, True]
    assert np.array_equal(got[3], vector(" ab") + vector("ab ") + 8999 * vector("bab") + 8999 * vector("aba"))


def _naive_vector(text, profiler):
    """The sum of the bound trigrams of a text's words, one after another."""
    slot = lambda c: 0 if not c.isalpha() else ord(c.lower()[:1]) - 96 if "a" <= c.lower()[:1] <= "z" else 27 + ord(c.lower()[:1]) % (language.SLOTS - 27)
    letters = [slot(c) for c in text]
    out = np.zeros(profiler.dimensions)
    for word in "".join(chr(s) for s in letters).split("\0"):
        line = [0, *map(ord, word), 0] if word else []
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            out += profiler.rolled[0][a] * profiler.rolled[1][b] * profiler.rolled[2][c]
    return out


def test_languages_are_those_of_the_nearest_prototype(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    profiler = language.Profiler()
    vectors = {d: _naive_vector(t, profiler) for d, t, _ in rows}
    sums = {}
    for d, _, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vectors[d] / np.linalg.norm(vectors[d])
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for r in q.op7_language(spark, small).collect():
        want = {name: cosine(vectors[r["doc_id"]], s) for name, s in sums.items()}
        assert r["lang_pred"] == max(want, key=want.get) and abs(r["score"] - max(want.values())) < 1e-5


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = " ".join(fuzz(500)).encode()
    whole = language.Profiler(64)._vectors([text])
    monkeypatch.setattr(language._pieces, "__defaults__", (97,))
    assert b"".join(language._pieces(text)) == text and len(language._pieces(text)) > 50
    got = language.Profiler(64).vectors([b"", text])
    assert np.array_equal(got[0][1], whole[0][0]) and got[1].tolist() == [False, True]


def test_language_cases(awkward, nothing):
    names, prototypes = language.learn(awkward)
    assert names == ["de", "en"]
    rows = {r["text"]: r for r in language.identify(awkward, names, prototypes).collect()}
    assert all((rows[t]["lang_pred"], rows[t]["score"]) == ("und", 0) for t in (None, "", " \n\t ", "12 34 --- !!"))
    assert rows["日本語のテキスト と English 混在 éÉß ñ"]["lang_pred"] != "und"
    none, empty = language.learn(nothing)
    assert none == [] and {r["lang_pred"] for r in language.identify(awkward, none, empty).collect()} == {"und"}
    assert language.identify(nothing, names, prototypes).count() == 0


def _toxic_texts(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(20, 200))]
        if k % 5 == 0:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["scumbag", "worthless", "pathetic"]))
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    return rows


def test_toxicity_reaches_held_out_texts_and_misspellings(spark, awkward, nothing):
    rows = _toxic_texts(800, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs)
    fresh = spark.createDataFrame(_toxic_texts(300, 2), "doc_id long, text string, toxic int")
    got = toxicity.score(fresh, model).collect()
    hit = [r["score"] >= 0.5 for r in got if r["toxic"]]
    wrong = [r["score"] >= 0.5 for r in got if not r["toxic"]]
    assert np.mean(hit) > 0.9 and np.mean(wrong) < 0.05
    spelt = spark.createDataFrame([("abc abd jig worthles fig hid ab cd",), ("abc abd jig bead fig hid ab cd",)], "text string")
    a, b = (r["score"] for r in toxicity.score(spelt, model).collect())
    assert a > b
    scores = [r["score"] for r in toxicity.score(awkward.drop("score"), model).collect()]
    assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
    assert len(set(scores[:3])) == 1  # null, empty and blank
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_learns_from_the_ends_of_long_texts(spark):
    long = "abc abd " * 7_600
    clean = [(k, f"abc abd {t}", 0) for k, t, y in _toxic_texts(400, 3) if not y]
    rows = [*clean, *((1000 + k, long + "scumbag worthless pathetic " * 2, 1) for k in range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs)
    fresh = spark.createDataFrame([("abc scumbag worthless pathetic jig",), ("abc abd jig bead fig",)], "text string")
    toxic, other = (r["score"] for r in toxicity.score(fresh, model).collect())
    assert toxic > 0.5 > other


def test_toxicity_learns_from_thousands_of_labels(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "int(id % 2) AS toxic")
    monkeypatch.setattr(toxicity, "train", lambda words, ids, labels, rate: (len(words), len(ids), labels.sum(), rate))
    assert toxicity.learn(docs, docs) == (5001, 5000, 2500, 0.5)


def test_toxic_phrases_score_alike_at_any_offset():
    found = [toxicity.best_passage(np.array([0.0] * k + [1.0] * 6 + [0.0] * (20 - k))) for k in range(21)]
    assert found == [(1.0, k) for k in range(21)]
    assert [toxicity.passages(n).tolist() for n in (1, 6, 8)] == [[0], [0], [0, 1, 2]]


def test_ngrams_and_passages_against_naive_ones():
    words = ["ab", "ünï", "a", "longer", "x" * 9, "\U0001f600b"]
    buckets, sizes = toxicity.ngrams(words)

    def naive(word):
        points, out = [ord(c) for c in f"<{word}>"], []
        for n in toxicity.GRAMS:
            for a in range(len(points) - n + 1):
                h = n
                for k in range(n):
                    h = (h ^ points[a + k]) * int(toxicity._FACTORS[k]) % (1 << 64)
                    h ^= h >> 29
                out.append(h % toxicity.BUCKETS)
        return out

    assert sizes.tolist() == [len(naive(w)) for w in words]
    ends = np.cumsum(sizes)
    assert [sorted(buckets[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)] == [sorted(naive(w)) for w in words]
    rng = np.random.default_rng(2)
    shares = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(shares, 1.5, -0.25)
    text = [words[k] for k in rng.integers(0, len(words), 40)]
    each = [np.mean([float(shares[b]) for b in naive(w)]) for w in text]
    want = max(np.mean(each[a : a + toxicity.PASSAGE]) for a in range(len(each) - toxicity.PASSAGE + 1))
    best, _ = toxicity.best_passage(model.words(text))
    assert abs(best - want) < 1e-5 and abs(float(model.probability(np.array(best))) - 1 / (1 + np.exp(0.25 - 1.5 * want))) < 1e-5


def test_the_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(7)
    vectors, weights, bias = rng.normal(size=(30, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    sizes, lengths, labels = rng.integers(1, 5, 9), np.array([2, 3, 4]), np.array([1, 0, 1])
    grams = rng.integers(0, 20, sizes.sum())
    loss = lambda: toxicity.gradient(vectors, weights, bias, grams, sizes, lengths, labels)[0]
    _, touched, step, d_weights, d_bias = toxicity.gradient(vectors, weights, bias, grams, sizes, lengths, labels)
    whole = np.zeros_like(vectors)
    whole[touched] = step
    for values, slopes in ((vectors, whole), (weights, d_weights), (bias, d_bias)):
        for at in np.ndindex(values.shape):
            before, tiny = values[at], 1e-6
            values[at] = before + tiny
            up = loss()
            values[at] = before - tiny
            down = loss()
            values[at] = before
            assert abs((up - down) / (2 * tiny) - slopes[at]) < 1e-6


def test_toxicity_without_labels_of_both_kinds(spark, nothing):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.learn(docs, none) == 0.0
    assert toxicity.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) == 1.0
    assert [r["score"] for r in toxicity.score(docs, 0.0).collect()] == [0.0, 0.0]


def test_toxicity_query(spark, small):
    rows = q.op4_toxicity(spark, small).collect()
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_lookup_of_hot_cold_and_null_keys(spark):
    keys = [1] * 3000 + [2] * 3 + [None] * 50 + [3]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key long, n long")
    found = materialise(spark.createDataFrame([(1, "hot", 3000), (2, "cold", 3)], "key long, value string, times long"))
    got = Counter(r["value"] for r in lookup(rows, found, "key", "times").collect())
    assert got == {"hot": 3000, "cold": 3, None: 51}


def test_toxicity_scores_are_those_of_a_naive_scorer(spark, awkward):
    """Each passage of each text is scored by itself, n-gram by n-gram."""
    model = toxicity.learn(*[spark.createDataFrame(_toxic_texts(400, 5), "doc_id long, text string, toxic int")] * 2)
    odd = [(k, t, 0) for k, t in enumerate(["", None, "a", "Ein kurzer Text.", "12 34", "日本語 x", "word " * 50])]
    docs = spark.createDataFrame(_toxic_texts(60, 6) + odd, "doc_id long, text string, toxic int")
    share = {}

    def word_score(word):
        if word not in share:
            buckets, sizes = toxicity.ngrams([word])
            assert sizes.tolist() == [len(buckets)] and len(buckets) == sum(max(0, len(word) + 3 - n) for n in toxicity.GRAMS)
            share[word] = sum(float(model.shares[b]) for b in buckets.tolist()) / len(buckets)
        return share[word]

    for r in toxicity.score(docs, model).collect():
        scores = [word_score(w) for w in toxicity.words_of(r["text"] or "")]
        size = min(toxicity.PASSAGE, len(scores))
        best = max((sum(scores[i : i + size]) / size for i in range(len(scores) - size + 1)), default=0.0) if scores else 0.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * best + model.shift))), abs=1e-6)


def test_long_pretokens_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHORT", 20)
    monkeypatch.setattr(tokens, "HELD_BYTES", 3000)
    rows = [(k, "x" * (50 + k % 7) + " ab" * (k % 5)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = tokens.pieces_of(docs, PIECES)
    hot, _ = tokens._hot(parts)
    assert hot and all(len(p) <= 20 for p in hot)
    monkeypatch.setattr(tokens, "HOT_BYTES", 2)
    assert tokens._hot(parts)[0] == {}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(tokens, "HOT_BYTES", 1 << 20)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, PIECES).collect()}
    assert got == {k: len(model.encode(t)) for k, t in rows}
