"""Learnt sentence boundaries, against a plain implementation of the method."""

import re
from collections import Counter, defaultdict
from math import exp, log

import pytest
from pyspark.sql import functions as F

from folioweave.operators import punkt

TEXTS = [
    "Dr. Ali datang. Ia membawa buku, pena, dll. untuk kelas. Lihat No. 5 dan No. 7 hari ini! Benar?",
    "Kemarin Dr. Budi pergi ke kantor. Harga naik 3.5 persen. Di pasal 5. harga turun (lihat hal. 3).",
    'Menurut J. Smith dan J. Smith itu salah. Lalu ... ia pergi. "Selesai." Mereka pulang. Anehnya harga no. 7 turun.',
    "Semua orang, dll. yang lain pulang. Harga dr. Budi naik, e.g. 5. persen. Ia (dr. Ali) datang?",
    "Rapat dll. Ia pulang sore hari. Kemarin mereka datang ke kelas. Pada 12. Januari mereka pergi… lalu pulang.",
]


def shown(word):
    core = re.sub("[\"')\\]}”’»,;:!?]+\\Z", "", re.sub("^[\"'(\\[{“‘«¿¡]+", "", word))
    dots = core.endswith(("..", "…"))
    bare = re.sub(r"\.\Z", "", core).lower()
    kind = "…" if dots else "#" if re.match(r"[-+]?[0-9]+([.,][0-9]+)*\Z", bare) else bare if re.search(r"\w", bare.replace("_", "")) else ""
    case = 1 if core[:1].isupper() else 0 if core[:1].islower() else None
    mark = lambda x: bool(re.search(f"[{x}][\"')\\]}}”’»]*\\Z", word))
    return kind, core.endswith(".") and not dots, mark(".…"), mark("!?"), case


def ratio(a, b, ab, n):
    chance = lambda k, m, p: (k * log(p) if k else 0) + ((m - k) * log(1 - p) if m - k else 0)
    return -2 * (chance(ab, a, b / n) + chance(b - ab, n - a, b / n) - chance(ab, a, ab / a) - chance(b - ab, n - a, (b - ab) / (n - a)))


class Plain:
    """Token by token, in three passes over all texts."""

    def __init__(self, texts):
        docs = [[shown(w) for w in t.split()] for t in texts if t]
        initial = lambda t: len(t) == 1 and t.isalpha()
        n, k = Counter(), Counter()
        for tokens in docs:
            for t, stop, *_ in tokens:
                n[t] += t != ""
                k[t] += t != "" and stop
        total, stops = sum(n.values()), sum(k.values())
        share = stops / total if 0 < stops < total else 0.5
        self.short = set()
        for t in n:
            size = len(t.replace(".", ""))
            if n[t] and k[t] and t not in "#…" and size:
                score = -2 * (k[t] * log(share) + (n[t] - k[t]) * log(1 - share) - k[t] * log(0.99) - (n[t] - k[t]) * log(0.01))
                if score * exp(-size) * (t.count(".") + 1) * size ** -(n[t] - k[t]) >= 0.3:
                    self.short.add(t)
        seen, at_break, joint, breaks = defaultdict(set), Counter(), Counter(), 0
        for tokens in docs:
            for i, (t, _, _, _, case) in enumerate(tokens):
                if not t:
                    continue
                place = "start"
                if i:
                    b, stop, open_, mark, _ = tokens[i - 1]
                    uncertain = not mark and open_ and (stop or b == "…")
                    begins = mark or (uncertain and b not in self.short and b not in "#…" and not initial(b)) or (uncertain and b == "")
                    place = "break" if begins else "odd" if uncertain else "word"
                    breaks += begins
                    at_break[t] += begins
                    if uncertain and (b == "#" or initial(b)) and t not in "#…":
                        joint[b, t] += 1
                seen[t].add((place, case))
        of = lambda t, *places, case: any((p, case) in seen[t] for p in places or ("start", "break", "odd", "word"))
        self.lower = {t for t in seen if of(t, case=0)}
        self.opens = {t for t in self.lower if not of(t, "word", case=1)}
        self.either = {t for t in seen if of(t, "start", "break", case=0) and not of(t, case=1)}
        self.starters = {t for t in seen if t not in "#…" and at_break[t] and ratio(breaks, n[t], at_break[t], total) >= 30 and total * at_break[t] > n[t] * breaks}
        self.pairs = {(b, t) for (b, t), ab in joint.items() if ab > 1 and t not in self.starters and ratio(n[b], n[t], ab, total) >= 7.88 and total * ab > n[b] * n[t]}
        self.initial = initial

    def ends(self, word, after):
        b, _, _, mark, _ = shown(word)
        t, _, _, _, case = shown(after)
        if mark:
            return True
        begins = True if case == 1 and t in self.opens else False if case == 0 and t not in self.either else None
        if b == "…" or (b in self.short and not self.initial(b)):
            return begins if begins is not None else t in self.starters and case == 1
        if b == "#" or self.initial(b):
            if (b, t) in self.pairs:
                return False
            return begins if begins is not None else not (self.initial(b) and case == 1 and t not in self.lower)
        return True

    def split(self, text):
        out, own = [], ""
        for part in re.findall(r"\s+|\S+", text):
            own += part
            if part.isspace() and re.search("[.!?…][\"')\\]}”’»]*\\Z", own.rstrip()):
                rest = text[sum(map(len, out)) + len(own) :].split()
                if rest and self.ends(own.split()[-1], rest[0]):
                    out.append(own)
                    own = ""
        return [s.strip() for s in [*out, own] if s.strip()]


def corpus(times):
    rows = [t for k, t in enumerate(TEXTS) for _ in range(times + k)]
    return [*rows, None, "", "  \n ", "tanpa titik", "A. B. C. d. 1. 2. x", "x" * 100_000 + ". " + "kata " * 5000 + "Dr. Ali"]


@pytest.mark.parametrize("times", [1, 9, 60])
@pytest.mark.parametrize("literal", [1 << 20, -1])
def test_sentences_are_those_of_the_plain_method(spark, monkeypatch, times, literal):
    monkeypatch.setattr(punkt, "LITERAL", literal)
    rows = corpus(times)
    docs = spark.createDataFrame([(k % 7 or None, t) for k, t in enumerate(rows)], "doc_id long, text string").withColumn("type", F.lit("own"))
    model, plain = punkt.learn(docs), Plain(rows)
    found = {r["type"]: r for r in model.types.collect()}
    for name, own in (("abbreviation", plain.short), ("starter", plain.starters), ("lower", plain.lower), ("opens", plain.opens), ("either", plain.either)):
        assert {t for t, r in found.items() if r[name]} == own, name
    assert {tuple(r) for r in model.pairs.collect()} == plain.pairs
    got = sorted(((r["text"], r["sentences"]) for r in punkt.split(docs, model).collect()), key=repr)
    assert got == sorted(((t, plain.split(t) if t is not None else None) for t in rows), key=repr)
    model.forget()


def test_abbreviations_end_no_sentence(spark):
    filler = ["Semua orang pergi ke kantor. Mereka membawa buku tulis. Lihat no. 3 saja. Rumah itu besar, dll. yang lain kecil. Kata dr. Budi itu benar."] * 40
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*filler, "Ada Dr. Ali. Buku, pena, dll. untuk kelas. Lihat No. 5 hari ini."])], "doc_id long, text string")
    found = punkt.split(docs, punkt.learn(docs)).where("doc_id = 40").first()["sentences"]
    assert found == ["Ada Dr. Ali.", "Buku, pena, dll. untuk kelas.", "Lihat No. 5 hari ini."]


def test_a_model_serves_other_texts_and_nothing_teaches_nothing(spark, small):
    learnt = punkt.learn(spark.createDataFrame([(t,) for t in TEXTS * 30], "text string"))
    others = spark.createDataFrame([("Tanya Dr. Siti saja. Besok no. 9 buka.",)], "text string")
    assert punkt.split(others, learnt).first()["sentences"] == ["Tanya Dr. Siti saja.", "Besok no. 9 buka."]
    empty = spark.createDataFrame([], "text string")
    nothing = punkt.learn(empty)
    assert nothing.types.count() == 0 and punkt.split(empty, nothing).collect() == []
    assert punkt.split(others, nothing).first()["sentences"] == ["Tanya Dr.", "Siti saja.", "Besok no.", "9 buka."]
    cut = punkt.split(spark.read.parquet(f"{small}/documents.parquet"), learnt)._jdf.queryExecution().toString()
    assert "Python" not in cut and "Arrow" not in cut


def test_words_are_counted_before_their_kinds_are_told(spark):
    """The filter on kinds lies above the counting of words: below it, it would run for each word of each text."""
    plan = punkt.counted(spark.createDataFrame([("a b. C",)], "text string"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counts = [k for k, line in enumerate(plan) if "Aggregate" in line]
    kinds = [k for k, line in enumerate(plan) if "Filter" in line and "RLIKE" in line]
    assert len(counts) == 2 and kinds and max(kinds) < counts[1]


@pytest.mark.parametrize("word", ["x" * 23, "x" * 24, "x" * 25, "(“" + "y" * 60 + "”)", "é" * 24, "a"])
def test_words_longer_than_what_is_looked_at_first(spark, word):
    rows = [("one " * 20 + f"{word}.  \u3000{word} two " * 2 + "dr. " + word,), (f"  {word}. {word}",)] * 3
    docs = spark.createDataFrame(rows, "text string")
    plain = Plain([r[0] for r in rows])
    assert [r["sentences"] for r in punkt.split(docs, punkt.learn(docs)).collect()] == [plain.split(r[0]) for r in rows]


@pytest.mark.parametrize("learnt", [True, False])
@pytest.mark.parametrize("times", [1, 9, 60])
def test_a_model_past_the_plan_moves_no_text(spark, monkeypatch, times, learnt):
    rows = corpus(times)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    model, plain = punkt.learn(docs), Plain(rows)
    short = model.types.where("abbreviation").agg(F.coalesce(F.sum(F.octet_length("type") + 16), F.lit(0))).first()[0]
    monkeypatch.setattr(punkt, "LITERAL", short)
    found = punkt.split(docs, model, learnt=learnt)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = sorted(((r["text"], r["sentences"]) for r in found.collect()), key=repr)
    assert got == sorted(((t, plain.split(t) if t is not None else None) for t in rows), key=repr)
    model.forget()


def test_words_are_counted_past_the_limit(spark, monkeypatch):
    docs = spark.createDataFrame([("a b. C d! e \u3000x. y",), ("a b. C",), (None,), ("",)] * 3, "text string").coalesce(1)
    whole = sorted(punkt.counted(docs).collect(), key=repr)
    monkeypatch.setattr(punkt, "COUNTED", 2)
    assert sorted(punkt.counted(docs).collect(), key=repr) == whole and sum(r["n"] for r in whole) == 30
