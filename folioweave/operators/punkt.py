"""Sentence boundaries that are learnt from the texts themselves, without any labels (the method of Kiss and Strunk, 2006).

A type is a word without case, and without quotes, brackets and punctuation around it; numbers are one type. ``learn``
counts, in one pass, which types stand with and without a full stop and what follows them. A type is an abbreviation if
the likelihood ratio of "it nearly always has its full stop" against "it has one as often as any word", weighted for
short types and for full stops inside, and against those often seen without, reaches ABBREVIATION. From the same counts come words
that start sentences more often than chance allows, words that follow numbers and initials more often, and where each
word is seen with a capital. ``split`` then decides each full stop before white space: after an abbreviation or dots the sentence ends only if
the next word shows by its capital, or as a frequent starter, that it begins one; after an initial or a number it doesn't
end if the next word is no beginning, or belongs to it; after any other word it ends, as it does after ``!`` and ``?``.

Counting is two aggregations, of words as they are written, counted by Python where they are read (at most COUNTED different ones at once), and of their
types, with partial sums in each task, so a frequent word is a row from each.
What of the model these texts need (its abbreviations, and the words seen behind an uncertain full stop) is measured first, from the
counts if it was learnt from the same texts, by reading them once more if not: up to LITERAL bytes it goes into the plan as sets, and texts are cut where they are read; up to HELD bytes (if the abbreviations are within LITERAL)
it is broadcast to Python, which is asked about pairs of words behind an uncertain full stop, and no text moves either; beyond that, boundaries are joined with
the model by shuffles, and only their places come back to the texts.

Cases: null texts give null, blank ones no sentences; a text of any length is read whole; repeated rows count each, and
rows without an id are rows like others; no texts give an empty model, under which every full stop ends a sentence; columns
of the names used here (``_row``, ``_units``, ``_open``) are in the way, others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from folioweave.functions.cleaning import strip
from folioweave.functions.patterns import BLANKS, SPACES, S
from folioweave.functions.vectors import bound

# Fixed values of the method: the least scores of abbreviations, collocations and starters, and the share of full stops that abbreviations have
ABBREVIATION, COLLOCATION, STARTER, STOPPED = 0.3, 7.88, 30.0, 0.99
#: Characters in which a word at a unit's end is looked for first.
NEAR = 24
#: Bytes of learnt types that may stand in a plan.
LITERAL = 1 << 20
#: Bytes of learnt types that each Python worker may hold.
HELD = 32 << 20
#: Different words and pairs of words that a task counts before it passes them on.
COUNTED = 1 << 18

CLOSERS = "\"')\\]}”’»"
OPENERS = "\"'(\\[{“‘«¿¡"
_CLOSING, _OPENING = CLOSERS.replace("\\", ""), OPENERS.replace("\\", "")
#: A unit: up to a mark that may end a sentence, closing quotes and brackets behind it, and white space.
UNIT = f"(?s).+?(?:[.!?…][{CLOSERS}]*{S}+|\\z)"
WORD = f"[^{SPACES}]+"
_SPACES = BLANKS
NUMBER, DOTS = "#", "…"
_LEFT, _RIGHT = f"^[{OPENERS}]+", f"[{CLOSERS},;:!?]+\\z"
_NUMBER = "^[-+]?[0-9]+([.,][0-9]+)*\\z"


@dataclass
class Model:
    """``types``: type, abbreviation, starter, and how it is written: ``lower`` (small letter anywhere), ``opens`` (capital: a beginning), ``either`` (small letter: perhaps one).
    ``pairs``: numbers and initials (``before``) with what belongs to them (``type``)."""

    types: DataFrame
    pairs: DataFrame
    held: tuple[DataFrame, ...] = ()
    #: Types of words with a full stop (``before``) and of those behind them (``type``), in the texts that it was learnt from.
    met: DataFrame | None = None

    def forget(self) -> None:
        """Gives up what Spark keeps for the tables; they are made again if they are read later."""
        for table in self.held:
            table.unpersist()


def _core(word: Column) -> Column:
    return F.rtrim(F.ltrim(word, F.lit(_OPENING)), F.lit(_CLOSING + ",;:!?"))


def _bare(core: Column) -> Column:
    return F.lower(F.when(core.endswith("."), F.left(core, F.length(core) - 1)).otherwise(core))


def _dots(core: Column) -> Column:
    return core.endswith("..") | core.endswith(DOTS)


def _kind(core: Column, bare: Column) -> Column:
    """The type; most words are told by their first or last character, the others by patterns."""
    first = F.left(bare, F.lit(1))
    number = F.right(bare, F.lit(1)).between("0", "9") & bare.rlike(_NUMBER)
    letters = first.between("a", "z") | first.between("0", "9") | bare.rlike("[\\p{L}\\p{Nd}]")
    return F.when(_dots(core), DOTS).when(number, NUMBER).otherwise(F.when(letters, bare).otherwise(""))


def _case(core: Column) -> Column:
    """Of the first letter: 1 capital, 0 small, null neither."""
    first = F.left(core, F.lit(1))
    return F.when(first.between("a", "z"), 0).when(first.between("A", "Z"), 1).when(first.rlike("^\\p{Lu}"), 1).when(first.rlike("^\\p{Ll}"), 0)


def _stop(core: Column) -> Column:
    return core.endswith(".") & ~_dots(core)


def _ends_in(word: Column, *marks: str) -> Column:
    """Whether the word's last character but for closing quotes and brackets is one of these."""
    bared = F.rtrim(word, F.lit(_CLOSING))
    return reduce(or_, (bared.endswith(m) for m in marks))


def _word_at(unit: Column, end: int) -> Column:
    """The first (1) or last (-1) word, looked for in the unit's NEAR characters at that end; in all of it only where they hold no end of the word."""
    plain = lambda part: F.trim(F.translate(part, _SPACES, " " * len(_SPACES)))
    near = (F.left if end == 1 else F.right)(unit, F.lit(NEAR))
    return bound(plain(near), lambda part: F.substring_index(F.when(part.contains(" "), part).otherwise(plain(unit)), " ", end))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (``w``) with those before them (``b``; null at a text's start, empty for one without a mark) and how often; white space is that of SPACES."""

    def passed() -> pa.RecordBatch:
        for (w, _), n in pairs.items():
            words[w] -= n
        plain = [w for w, n in words.items() if n]
        rows = [[*(w for w, _ in pairs), *plain], [*(b for _, b in pairs), *[""] * len(plain)], [*pairs.values(), *(words[w] for w in plain)]]
        made = pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["w", "b", "n"])
        words.clear()
        pairs.clear()
        return made

    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str | None]] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            own = (text.as_py() or "").split()
            words.update(own)
            pairs.update([(w, b) for b, w in zip(own, own[1:], strict=False) if not b.isalpha() and ("." in b or "!" in b or "?" in b or DOTS in b)])
            pairs.update((w, None) for w in own[:1])
            if len(words) + len(pairs) > COUNTED:
                yield passed()
    yield passed()


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often (``n``) each ``type`` is seen with each case and full stop behind each kind of word: ``behind`` is start, mark, stop (then ``before`` is its type), or word."""
    # words are counted as they are written, with those before them that may end a sentence; kinds are told once for each pair
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_counting, "w string, b string, n long").groupBy("w", "b").agg(F.sum("n").alias("n"))
    rows = rows.select("w", "b", "n", _core(F.col("w")).alias("wc"), _core(F.col("b")).alias("bc"))
    uncertain = _ends_in(F.col("b"), ".", DOTS) & (F.col("bc").endswith(".") | _dots(F.col("bc")))
    behind = F.when(F.col("b").isNull(), "start").when(_ends_in(F.col("b"), "!", "?"), "mark").when(uncertain, "stop").otherwise("word")
    # by the count, which is always positive, so that the filter isn't pushed below the counting and run for every word
    kind = F.when(F.col("n") > 0, _kind(F.col("wc"), F.col("wb")))
    rows = rows.withColumn("wb", _bare(F.col("wc"))).select("n", behind.alias("behind"), "bc", kind.alias("type"), _stop(F.col("wc")).alias("stop"), _case(F.col("wc")).alias("case")).where(F.col("type") != "")
    before = F.when(F.col("behind") == "stop", _kind(F.col("bc"), _bare(F.col("bc"))))
    return rows.select("n", "behind", before.alias("before"), "type", "stop", "case").groupBy("behind", "before", "type", "stop", "case").agg(F.sum("n").alias("n"))


def is_initial(kind: Column) -> Column:
    return kind.rlike("^\\p{L}\\z")


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio for ``ab`` joint occurrences of what occurs ``a`` and ``b`` times among ``n``."""
    chance = lambda k, m, p: F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(m - k > 0, (m - k) * F.ln(1 - p)).otherwise(0.0)
    alone, behind, other = b / n, ab / a, (b - ab) / (n - a)
    return -2 * (chance(ab, a, alone) + chance(b - ab, n - a, alone) - chance(ab, a, behind) - chance(b - ab, n - a, other))


def learn(docs: DataFrame, text: str = "text") -> Model:
    """The model of these texts."""
    return model_of(counted(docs, text))


def model_of(found: DataFrame) -> Model:
    """The model of the counts ``found``."""
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    total, stops = found.agg(F.sum("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0))).first()
    total, stops = total or 0, stops or 0
    word = ~F.col("type").isin(NUMBER, DOTS)
    each = found.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("k"))
    share = stops / total if 0 < stops < total else 0.5
    n, k = F.col("n"), F.col("k")
    ratio = -2 * (k * log(share) + (n - k) * log(1 - share) - k * log(STOPPED) - (n - k) * log(1 - STOPPED))
    size = F.length(F.regexp_replace("type", "\\.", ""))
    inside = F.length("type") - size + 1
    score = ratio * F.exp(-size) * inside * F.pow(size.cast("double"), (k - n).cast("double"))
    each = each.withColumn("abbreviation", word & (k > 0) & (size > 0) & (score >= ABBREVIATION))
    # what the word before is makes a word's place a beginning, an inside or neither
    known = each.where("abbreviation").select(F.col("type").alias("before"), F.lit(True).alias("short"))
    placed = found.join(known, "before", "left")
    odd = (F.col("before") == NUMBER) | (F.col("before") == DOTS) | is_initial(F.col("before"))
    begins = (F.col("behind") == "mark") | ((F.col("behind") == "stop") & F.col("short").isNull() & ~F.coalesce(odd, F.lit(False)))
    placed = placed.select("type", "before", "n", "case", begins.alias("begins"), ((F.col("behind") == "start") | begins).alias("first"), (F.col("behind") == "word").alias("inside"))
    seen = lambda c: F.coalesce(F.max(c), F.lit(False))
    upper, lower = F.col("case").eqNullSafe(1), F.col("case").eqNullSafe(0)
    forms = placed.groupBy("type").agg(
        F.sum(F.when(F.col("begins"), F.col("n")).otherwise(0)).alias("at_break"), seen(upper).alias("upper"), seen(lower).alias("lower"),
        seen(upper & F.col("inside")).alias("upper_inside"), seen(lower & F.col("first")).alias("lower_first"),
    )
    breaks = placed.agg(F.sum(F.when(F.col("begins"), F.col("n")))).first()[0] or 0
    types = each.join(forms, "type")
    much = F.lit(float(total))
    often = F.col("at_break") > 0
    starts = often & word & (_ratio(F.lit(float(breaks)), n, F.col("at_break"), much) >= STARTER) & (total * F.col("at_break") > n * breaks) if breaks else F.lit(False)
    types = types.withColumn("starter", F.coalesce(starts, F.lit(False))).withColumn("opens", F.col("lower") & ~F.col("upper_inside")).withColumn("either", F.col("lower_first") & ~F.col("upper")).persist(StorageLevel.MEMORY_AND_DISK)
    # numbers and initials with what follows them
    joint = found.where((F.col("behind") == "stop") & ((F.col("before") == NUMBER) | is_initial(F.col("before"))) & word).groupBy("before", "type").agg(F.sum("n").alias("ab")).where("ab > 1")
    joint = joint.join(types.select("type", F.col("n").alias("b"), "starter"), "type").join(types.select(F.col("type").alias("before"), F.col("n").alias("a")), "before")
    pairs = joint.where(~F.col("starter") & (_ratio(F.col("a"), F.col("b"), F.col("ab"), much) >= COLLOCATION) & (total * F.col("ab") > F.col("a") * F.col("b")))
    met = found.where(F.col("behind") == "stop").select("before", "type").distinct()
    return Model(types.select("type", "abbreviation", "starter", "lower", "opens", "either"), pairs.select("before", "type"), (found, types), met)


def _ends(mark: Column, before: Column, case: Column, abbreviation: Column, starter: Column, lower: Column, opens: Column, either: Column, pair: Column) -> Column:
    """Whether a sentence ends before a word of this case and with these properties."""
    begins = F.when(case == 1, F.when(opens, True)).when(case == 0, F.when(~either, False))
    initial = is_initial(before)
    short = (before == DOTS) | (abbreviation & ~initial)
    behind_short = F.coalesce(begins, starter & case.eqNullSafe(1))
    behind_number = ~pair & F.coalesce(begins, ~(initial & case.eqNullSafe(1) & ~lower))
    return mark | F.when(short, behind_short).when(initial | (before == NUMBER), behind_number).otherwise(True)


def _last(unit: Column) -> Column:
    """The type and mark of a unit's last word."""
    return bound(_word_at(unit, -1), lambda w: bound(_core(w), lambda core: bound(_bare(core), lambda bare: F.struct(_kind(core, bare).alias("type"), _ends_in(w, "!", "?").alias("mark")))))


def _between(units: Column, made) -> Column:
    """``made`` of the last word before each unit but the first (its type and mark) and that unit."""
    n = F.size(units)
    return F.zip_with(F.transform(F.slice(units, F.lit(1), n - 1), _last), F.slice(units, F.lit(2), n - 1), made)


def _boundaries(units: Column) -> Column:
    """For each unit but the first, the last word before it and its own first: type and mark of that, core of this."""
    made = lambda a, u: F.struct(a["type"].alias("before"), a["mark"].alias("mark"), _core(_word_at(u, 1)).alias("core"))
    return F.when(F.size(units) > 1, _between(units, made)).otherwise(F.array().cast("array<struct<before:string,mark:boolean,core:string>>"))


def _type(core: Column) -> Column:
    return bound(_bare(core), lambda bare: _kind(core, bare))


def _odd(kind: Column) -> Column:
    return (kind == NUMBER) | (kind == DOTS) | is_initial(kind)


def _joined(units: Column, ends: Column) -> Column:
    """Sentences of units; ``ends`` has the places (from 1) of the boundaries at which one ends."""
    n = F.size(units)
    ends = F.concat(ends.cast("array<int>"), F.array(n))
    from_ = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    cut = F.zip_with(from_, ends, lambda a, b: strip(F.array_join(F.slice(units, a + 1, b - a), "")))
    return F.when(units.isNotNull(), F.filter(cut, lambda s: F.length(s) > 0))


def split(docs: DataFrame, model: Model, text: str = "text", into: str = "sentences", *, learnt: bool = False) -> DataFrame:
    """``docs`` with the sentences of each text, stripped, none blank; ``learnt``: the model was learnt from these very texts."""
    units = F.when(F.length(F.col(text)) > 0, F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0))).otherwise(F.when(F.col(text).isNotNull(), F.array().cast("array<string>")))
    docs = docs.withColumn("_units", units)
    short = model.types.where("abbreviation").select("type")
    if (short.agg(F.sum(F.octet_length("type") + 16)).first()[0] or 0) > LITERAL:
        return _by_joins(docs, model, into)
    held = [r[0] for r in short.collect()]
    if learnt and model.met is not None:
        seen = model.met.where(_uncertain(F.col("before"), held))
    else:
        # the outer form: for a plain one all boundaries are found twice, as the optimiser infers a filter on their number
        seen = docs.select(F.explode_outer(_boundaries(F.col("_units"))).alias("x")).select("x.*").where(~F.col("mark") & _uncertain(F.col("before"), held))
        seen = seen.select("before", "core").distinct().select("before", _type(F.col("core")).alias("type")).distinct()
    seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
    rules, size = _rules(seen, model)
    seen.unpersist()
    if size <= LITERAL:
        found = docs.withColumn("_open", _by_sets(F.col("_units"), rules, held))
        rules.unpersist()
        return found.withColumn(into, _joined(F.col("_units"), F.col("_open"))).drop("_units", "_open")
    if size <= HELD:
        found = _by_broadcast(docs, rules, held)
        rules.unpersist()
        return found.withColumn(into, _joined(F.col("_units"), F.col("_open"))).drop("_units", "_open")
    rules.unpersist()
    return _by_joins(docs, model, into)


def _uncertain(before: Column, short: list[str]) -> Column:
    """Whether a sentence may go on behind a word of this type."""
    return before.isin(short) | _odd(before) if short else _odd(before)


def _rules(seen: DataFrame, model: Model) -> tuple[DataFrame, int]:
    """What of the model is asked of these pairs of an uncertain word and the next, as (rule, value), and its bytes."""
    behind = seen.select("type").distinct().join(model.types, "type")
    kinds = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("starter", "lower", "opens", "either"))), lambda x: x.isNotNull())
    pairs = seen.join(model.pairs, ["before", "type"]).select(F.lit("pair").alias("rule"), F.concat_ws(" ", "before", "type").alias("value"))
    rules = behind.select(F.explode(kinds).alias("rule"), F.col("type").alias("value")).unionByName(pairs).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    return rules, rules.agg(F.sum(F.octet_length("value") + 16)).first()[0] or 0


def _by_sets(units: Column, rules: DataFrame, short: list[str]) -> Column:
    sets: dict[str, list[str]] = {"abbreviation": short}
    for rule, value in rules.collect():
        sets.setdefault(rule, []).append(value)
    held = lambda rule, value: value.isin(sets[rule]) if sets.get(rule) else F.lit(False)
    told = lambda before, core, kind: _ends(F.lit(False), before, _case(core), held("abbreviation", before), *(held(rule, kind) for rule in ("starter", "lower", "opens", "either")), held("pair", F.concat_ws(" ", before, kind)))
    # the next word is looked at only where it decides
    judged = lambda before, unit: bound(_core(_word_at(unit, 1)), lambda core: bound(_type(core), lambda kind: told(before, core, kind)))
    ends = lambda last, unit: F.when(last["mark"] | ~_uncertain(last["type"], short), True).otherwise(judged(last["type"], unit))
    all_ = F.when(F.size(units) > 1, _between(units, ends)).otherwise(F.array().cast("array<boolean>"))
    return F.filter(F.transform(all_, lambda yes, i: F.when(yes, i + 1)), lambda i: i.isNotNull())


def _by_broadcast(docs: DataFrame, rules: DataFrame, short: list[str]) -> DataFrame:
    """``docs`` with ``_open``, the places at which sentences end; Python only looks words up."""
    names = ["starter", "lower", "opens", "either", "pair"]
    told: dict[str, int] = {}
    for rule, value in rules.collect():
        told[value] = told.get(value, 0) | 1 << names.index(rule)
    kept = docs.sparkSession.sparkContext.broadcast(told)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def looked(rows: pd.Series) -> pd.Series:
        known = kept.value.get
        return rows.map(lambda own: None if own is None else [known(pair.partition(" ")[2], 0) | known(pair, 0) for pair in own])

    # no type has a space, so a pair's name is never that of a type
    both = lambda before, core: F.struct(before.alias("before"), _case(core).alias("case"), _type(core).alias("type"))
    asked = lambda last, unit: F.when(~last["mark"] & _uncertain(last["type"], short), bound(_core(_word_at(unit, 1)), lambda core: both(last["type"], core)))
    placed = F.transform(_between(F.col("_units"), asked), lambda x, i: F.when(x.isNotNull(), F.struct((i + 1).alias("i"), x.alias("x"))))
    docs = docs.withColumn("_asked", F.when(F.size("_units") > 1, F.filter(placed, lambda x: x.isNotNull())))
    docs = docs.withColumn("_told", looked(F.transform("_asked", lambda a: F.concat_ws(" ", a["x"]["before"], a["x"]["type"]))))
    is_ = lambda mask, name: mask.bitwiseAND(1 << names.index(name)) != 0
    abbreviation = lambda x: x["before"].isin(short) if short else F.lit(False)
    ends = lambda x, mask: _ends(F.lit(False), x["before"], x["case"], abbreviation(x), *(is_(mask, name) for name in names))
    goes_on = F.filter(F.zip_with("_asked", "_told", lambda a, mask: F.when(~ends(a["x"], mask), a["i"])), lambda i: i.isNotNull())
    places = F.when(F.size("_units") > 1, F.array_except(F.sequence(F.lit(1), F.size("_units") - 1), goes_on)).otherwise(F.array().cast("array<int>"))
    return docs.withColumn("_open", places).drop("_asked", "_told")


def _by_joins(docs: DataFrame, model: Model, into: str) -> DataFrame:
    # equal texts are cut alike, so the text itself is what joins them
    docs = docs.withColumn("_row", F.sha2(F.array_join("_units", ""), 256))
    rows = docs.select("_row", F.posexplode(_boundaries(F.col("_units"))).alias("i", "x")).select("_row", (F.col("i") + 1).alias("i"), "x.*")
    rows = rows.select("_row", "i", "before", "mark", _type(F.col("core")).alias("type"), _case(F.col("core")).alias("case"))
    # each pair of words is judged once; a pair that is seen very often is a skewed key that Spark splits, as it has one judgement
    pairs = rows.select("before", "mark", "type", "case").distinct()
    own = model.types.select(F.col("type").alias("before"), F.col("abbreviation"))
    told = pairs.join(own, "before", "left").join(model.types.drop("abbreviation"), "type", "left").join(model.pairs.withColumn("pair", F.lit(True)), ["before", "type"], "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    judged = told.select("before", "mark", "type", F.coalesce("case", F.lit(-1)).alias("case"), _ends(F.col("mark"), F.col("before"), F.col("case"), *(is_(c) for c in ("abbreviation", "starter", "lower", "opens", "either", "pair"))).alias("ends"))
    ends = rows.withColumn("case", F.coalesce("case", F.lit(-1))).join(judged.where("ends"), ["before", "mark", "type", "case"])
    by_row = ends.groupBy("_row").agg(F.array_sort(F.collect_set("i")).alias("_open"))
    found = docs.join(by_row, "_row", "left")
    return found.withColumn(into, _joined(F.col("_units"), F.coalesce("_open", F.array().cast("array<int>")))).drop("_units", "_open", "_row")
