"""Secrets, and who holds them.

Three kinds of matches are the base: assignments to a name like ``password``, access keys and runs of hex digits. Besides,
any opaque token is a candidate: 20 or more letters, digits and ``+/_-``, with upper case, lower case and digits, but no
seven letters of one case in a row.

What a candidate says (the assigned value, the key, the run, the token) is hashed, and for each hash the distinct
repositories and owners that hold it are counted over the whole corpus. What ``EXAMPLE`` owners or more hold is copied
around: a span ``example``. What fewer hold, and looks random enough, is a credential of theirs: a span ``live``. Anything else gets
no span beside its base one.

Everything is made of Spark's built-in functions. Places aren't among what its regular expressions give, but the text
between matches and the matches are: their lengths, summed over a document's matches in order, are the places. Texts are
read once; from then on there are only lengths and hashes. Owners are counted by partial sums for (hash, owner), so a secret
that a third of all rows hold is a row from each task, and is then joined from a broadcast.

Cases: a null or empty text has no matches; a text of any length is read whole; repeated rows and rows without an id are
rows of their own; a null owner is one owner, and a null repository one repository; a candidate's spans of one kind and place are one;
no rows give no rows. The result has the id and the columns named, whatever else ``docs`` has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.common import lookup, materialise

# Patterns of the base kinds in the order of ties, the least length of a match, and that of what is assigned
VALUE = "[A-Za-z0-9+/_.=-]+"
KINDS = {
    "assign": rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE})""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The further candidates: maximal runs of 20 or more of these that have a capital, a small letter and a digit, and no part
#: that reads like a word.
OPAQUE, WORDLIKE = "[A-Za-z0-9+/_-]{20,}", "[a-z]{7}|[A-Z]{7}"
#: Owners from which on a secret is an example; distinct characters that a random-looking one has at least.
EXAMPLE, VARIED = 3, 10
#: Kinds of spans at one start, in this order.
ORDER = (*KINDS, "live", "example")


def _gaps(text: Column, pattern: str) -> Column:
    """Lengths of what lies before each match and behind the last."""
    return F.transform(F.split(text, pattern, -1), F.length)


def _matches(text: Column, kind: str) -> Column:
    """(kind, number, characters before it since the last match, its length, its value's length, value) of each match."""
    # runs of a class and longer ones of it start and end alike, so short ones needn't be listed
    pattern = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "opaque": OPAQUE}.get(kind, KINDS.get(kind))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda m: F.regexp_extract(m, pattern, 1)) if kind == "assign" else (lambda m: m)
    row = lambda m, gap, k: F.struct(F.lit(ORDER.index(kind) if kind in ORDER else -1).alias("kind"), k.alias("k"), gap.alias("gap"), F.length(m).alias("n"), value(m).alias("value"))
    # the part behind the last match has no match beside it
    return F.filter(F.zip_with(F.transform(found, lambda m, k: F.struct(m.alias("m"), k.alias("k"))), _gaps(text, pattern), lambda m, gap: row(m["m"], gap, m["k"])), lambda r: r["n"].isNotNull())


def _varied(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= VARIED


def candidates(docs: DataFrame, key: str, text: str, repository: str, owner: str) -> DataFrame:
    """All matches by row (``_row``; one with a null kind for each row without any): kind, start, end, where the value starts, its hash, whether it looks random."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    word = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in ("passw", "secret", "token", "key")))
    none = F.expr("array()")
    asked = {"assign": word, "access": F.contains(body, F.lit("AKIA"))}
    each = [F.when(asked[k], _matches(body, k)).otherwise(none) if k in asked else _matches(body, k) for k in (*KINDS, "opaque")]
    rows = docs.select(F.col(key).alias("_key"), F.col(repository).cast("string").alias("_repository"), F.col(owner).cast("string").alias("_owner"), F.concat(*each).alias("_found"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_key", "_repository", "_owner", F.explode_outer("_found").alias("m"))
    value = F.col("m.value")
    upper, lower, digit = (value.rlike(f"[{x}]") for x in ("A-Z", "a-z", "0-9"))
    opaque = upper & lower & digit & ~value.rlike(WORDLIKE)
    long = F.length(value) >= F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (ORDER.index(k), LEAST[k])), F.lit(-1), F.lit(0)), F.col("m.kind"))
    slim = materialise(
        rows.select(
            "_row", "_key", "_repository", "_owner", F.col("m.kind").alias("kind"), F.col("m.k").alias("k"), F.col("m.gap").alias("gap"), F.col("m.n").alias("n"),
            F.length(value).alias("n_value"), F.when(long & (opaque | (F.col("m.kind") >= 0)), F.sha2(value, 256)).alias("hash"), (_varied(value) & digit & (upper | lower)).alias("varied"),
        )
    )
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return slim.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).drop("gap", "k", "n")


def ownership(found: DataFrame) -> DataFrame:
    """For each hash of ``candidates`` its distinct repositories and owners, and how many candidates have it."""
    held = found.where(F.col("hash").isNotNull())
    # null counts as one more
    distinct = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long")
    by_owner = held.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("times")).groupBy("hash").agg(distinct("_owner").alias("owners"), F.sum("times").alias("times"))
    pairs = held.groupBy("hash", "_repository").agg(F.lit(1)).groupBy("hash").agg(distinct("_repository").alias("repositories"))
    return by_owner.join(pairs, "hash")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """For each row its key, ``base`` and ``spans``: arrays of (start, kind, end, hash, owners, repositories) by start, then kind.

    Kinds are places in ORDER; starts and ends count code points.
    """
    found = candidates(docs, key, text, repository, owner)
    told = lookup(found.drop("_repository", "_owner"), materialise(ownership(found)), "hash", "times")
    span = lambda start, kind: F.struct(start.cast("long").alias("start"), kind.cast("int").alias("kind"), F.col("end"), "hash", "owners", "repositories")
    own = F.when(F.col("hash").isNotNull() & (F.col("kind") >= 0), span(F.col("start"), F.col("kind")))
    verdict = F.when(F.col("owners") >= EXAMPLE, F.lit(ORDER.index("example"))).when(F.col("varied"), F.lit(ORDER.index("live")))
    more = F.when(F.col("hash").isNotNull() & verdict.isNotNull(), span(F.col("end") - F.col("n_value"), verdict))
    by_row = told.groupBy("_row", "_key").agg(F.array_sort(F.collect_list(own)).alias("base"), F.collect_set(more).alias("more"))
    spans = F.array_sort(F.concat("base", "more"))
    return by_row.select(F.col("_key").alias(key), "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    names = F.array(*(F.lit(k) for k in ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == ORDER.index(kind))).cast("long")
