"""Registered queries of learnt sentences, kept embeddings, strategies and reading order, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioweave.functions.patterns import S
from folioweave.operators import elements, embed, layout, maxmin, punkt, sentences
from folioweave.operators.cache import Cache, embed_cached
from folioweave.operators.rows import each
from folioweave.queries import ORACLES as OWN
from folioweave.queries import _fingerprint, _literal, _read, _stripped
from folioweave.sources.store import scratch

#: From this share of text on a page is partitioned into elements; below it, it is one.
SHARE = 0.75


def punkt_sentences(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = punkt.learn(docs)
    found = punkt.split(docs, model, learnt=True)
    model.forget()
    return each(found, "sentences", "doc_id", place="ord", value="sentence")


def punkt_types(spark, sf_dir):
    model = punkt.learn(_read(spark, sf_dir, "documents", "text"))
    model.forget()
    return model.types.where("type <> ''")


def maxmin_cached(spark, sf_dir):
    """Max-min chunks of sentences whose vectors come from a cache that half of the documents have filled before."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").withColumn("sentences", sentences.split_sentences(F.col("text")))
    cache = Cache(spark, scratch(spark), "hashing")
    embed_cached(docs.where("doc_id % 2 = 0"), "sentences", cache=cache, embedder=embed.hashing)
    found = maxmin.cluster(embed_cached(docs, "sentences", cache=cache, embedder=embed.hashing), "embeddings")
    own = maxmin.to_chunks(found, "sentences", "starts", "doc_id")
    return own.select("doc_id", "chunk_id", "num_sentences", _fingerprint(F.array_join("metadata.sentences", "\n")).alias("sentences_md5"))


def share_of_text(html: str) -> float:
    """The part of a page that isn't markup."""
    return len(re.sub("<[^>]*>", "", html)) / len(html) if html else 0.0


def whole(html: str):
    return iter([("UncategorizedText", html, None)])


def auto_strategy(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    found = elements.route(pages, "html", "url", share_of_text, {"fast": (SHARE, elements.html_partitioner), "hi_res": (0.0, whole)})
    return found.select("page_id", "strategy", F.round("share", 6).alias("share"), F.size("elements").alias("elements"))


def reading_order(spark, sf_dir):
    """Elements of pages laid out below each other in two columns under a heading of full width, put back into order from where they lie."""
    pages = elements.partition(_read(spark, sf_dir, "pages", "page_id", "url", "html"), "html", "url")
    half = F.ceil((F.size("elements") - 1) / 2)
    box = lambda e: F.struct(e["ord"].alias("ord"), F.lit(1).alias("page_number"), e["text"].alias("text"), *corners(e["ord"]))

    def corners(at):
        column, row = (at > half).cast("int"), F.when(at > half, at - half).otherwise(at)
        head = at == 0
        x0 = F.when(head, 0.0).otherwise(F.lit(60.0) * column)
        return (x.cast("double").alias(name) for name, x in (("x0", x0), ("y0", 12.0 * row), ("x1", F.when(head, 100.0).otherwise(x0 + 45)), ("y1", 12.0 * row + 9)))

    mixed = F.array_sort(F.transform("elements", lambda e: F.struct(F.xxhash64(e["element_id"]).alias("_h"), box(e).alias("e"))))
    laid = pages.where(F.size("elements") > 0).select("page_id", F.transform(mixed, lambda r: r["e"]).alias("boxes"))
    found = layout.in_reading_order(laid, "boxes")
    return found.select("page_id", F.posexplode("boxes").alias("place", "e")).select("page_id", "place", _fingerprint(F.col("e.text")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (punkt_sentences, punkt_types, maxmin_cached, auto_strategy, reading_order)}


def _fields(word: str) -> str:
    """A row for each distinct word: type, stop, open, mark and letter case."""
    is_ = lambda x, pattern: f"regexp_matches({x}, {_literal(pattern)})"
    return f"""
        SELECT w, CASE WHEN dots THEN {_literal(punkt.DOTS)} WHEN {is_('bare', punkt._NUMBER)} THEN '#' WHEN {is_('bare', '[\\p{L}\\p{Nd}]')} THEN bare ELSE '' END AS type,
               suffix(core, '.') AND NOT dots AS stop, {is_('w', f'[.…][{punkt.CLOSERS}]*\\z')} AS open, {is_('w', f'[!?][{punkt.CLOSERS}]*\\z')} AS mark,
               CASE WHEN {is_('core', '^\\p{Lu}')} THEN 1 WHEN {is_('core', '^\\p{Ll}')} THEN 0 END AS letter
        FROM (SELECT *, {is_('core', '(\\.\\.|…)\\z')} AS dots, lower(regexp_replace(core, '\\.\\z', '')) AS bare
              FROM (SELECT w, regexp_replace(regexp_replace(w, {_literal(punkt._LEFT)}, ''), {_literal(punkt._RIGHT)}, '') AS core FROM (SELECT DISTINCT w FROM {word})))"""


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    chance = lambda k, m, p: f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {m} - {k} > 0 THEN ({m} - {k}) * ln(1 - {p}) ELSE 0 END)"
    a, b, ab, n = (f"CAST({x} AS DOUBLE)" for x in (a, b, ab, n))
    return f"(-2 * ({chance(ab, a, f'({b} / {n})')} + {chance(f'({b} - {ab})', f'({n} - {a})', f'({b} / {n})')} - {chance(ab, a, f'({ab} / {a})')} - {chance(f'({b} - {ab})', f'({n} - {a})', f'(({b} - {ab}) / ({n} - {a}))')}))"


_INITIAL = "regexp_matches({0}, '^\\p{{L}}\\z')"
_MODEL = f"""
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        words AS MATERIALIZED (SELECT r, unnest(w) AS w, unnest(list_prepend(NULL, w[:-2])) AS b FROM (SELECT r, regexp_extract_all(text, {_literal(punkt.WORD)}) AS w FROM d) WHERE len(w) > 0),
        shown AS MATERIALIZED ({_fields('words')}),
        found AS MATERIALIZED (
            SELECT CASE WHEN p.b IS NULL THEN 'start' WHEN b.mark THEN 'mark' WHEN b.open AND (b.stop OR b.type = {_literal(punkt.DOTS)}) THEN 'stop' ELSE 'word' END AS behind,
                   CASE WHEN NOT b.mark AND b.open AND (b.stop OR b.type = {_literal(punkt.DOTS)}) THEN b.type END AS before, s.type, s.stop, s.letter, count(*) AS n
            FROM words p JOIN shown s ON s.w = p.w LEFT JOIN shown b ON b.w = p.b WHERE s.type <> '' GROUP BY ALL),
        sums AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (stop), 0) AS stops FROM found),
        each AS MATERIALIZED (
            SELECT type, n, k, type NOT IN ('#', {_literal(punkt.DOTS)}) AND k > 0 AND size > 0 AND ratio * exp(-size) * (length(type) - size + 1) * pow(size, k - n) >= {punkt.ABBREVIATION} AS abbreviation
            FROM (SELECT *, -2 * (k * ln(share) + (n - k) * ln(1 - share) - k * ln({punkt.STOPPED}) - (n - k) * ln(1 - {punkt.STOPPED})) AS ratio
                  FROM (SELECT *, CAST(length(replace(type, '.', '')) AS DOUBLE) AS size, (SELECT CASE WHEN stops > 0 AND stops < total THEN stops / total ELSE 0.5 END FROM sums) AS share
                        FROM (SELECT type, CAST(sum(n) AS DOUBLE) AS n, CAST(coalesce(sum(n) FILTER (stop), 0) AS DOUBLE) AS k FROM found GROUP BY type)))),
        placed AS MATERIALIZED (
            SELECT f.*, behind = 'mark' OR (behind = 'stop' AND NOT coalesce(e.abbreviation, false) AND before NOT IN ('#', {_literal(punkt.DOTS)}) AND NOT {_INITIAL.format('before')}) AS begins
            FROM found f LEFT JOIN each e ON e.type = f.before),
        forms AS (
            SELECT type, coalesce(sum(n) FILTER (begins), 0) AS at_break, coalesce(bool_or(letter = 1), false) AS upper, coalesce(bool_or(letter = 0), false) AS lower,
                   coalesce(bool_or(letter = 1 AND behind = 'word'), false) AS upper_inside, coalesce(bool_or(letter = 0 AND (begins OR behind = 'start')), false) AS lower_first FROM placed GROUP BY type),
        breaks AS (SELECT sum(n) AS breaks FROM placed WHERE begins),
        types AS MATERIALIZED (
            SELECT type, n, abbreviation, lower, lower AND NOT upper_inside AS opens, lower_first AND NOT upper AS either,
                   coalesce(at_break > 0 AND type NOT IN ('#', {_literal(punkt.DOTS)}) AND {_ratio('breaks', 'n', 'at_break', 'total')} >= {punkt.STARTER} AND total * at_break > n * breaks, false) AS starter
            FROM each JOIN forms USING (type), sums, breaks),
        pairs AS MATERIALIZED (
            SELECT before, j.type FROM (SELECT before, type, sum(n) AS ab FROM found WHERE behind = 'stop' AND (before = '#' OR {_INITIAL.format('before')}) AND type NOT IN ('#', {_literal(punkt.DOTS)}) GROUP BY ALL HAVING sum(n) > 1) j
            JOIN types b ON b.type = j.type JOIN types a ON a.type = j.before, sums
            WHERE NOT b.starter AND {_ratio('a.n', 'b.n', 'ab', 'total')} >= {punkt.COLLOCATION} AND total * ab > a.n * b.n)"""

_PUNKT = f"""
        WITH {_MODEL},
        units AS MATERIALIZED (SELECT r, unnest(u) AS u, unnest(range(len(u))) AS i FROM (SELECT r, regexp_extract_all(text, {_literal(punkt.UNIT)}) AS u FROM d WHERE text <> '')),
        ends AS (SELECT r, i, regexp_extract(u, {_literal(f'({punkt.WORD}){S}*\\z')}, 1) AS last, regexp_extract(u, {_literal(f'({punkt.WORD})')}, 1) AS first FROM units),
        ends2 AS MATERIALIZED (SELECT r, i, first, lag(last) OVER (PARTITION BY r ORDER BY i) AS last FROM ends),
        seen AS MATERIALIZED ({_fields('(SELECT first AS w FROM ends2 UNION ALL SELECT last FROM ends2 WHERE last IS NOT NULL)')}),
        asked AS (
            SELECT e.r, e.i, a.mark, a.type AS before, b.letter, coalesce(s.abbreviation, false) AS abbreviation, coalesce(t.starter, false) AS starter, coalesce(t.lower, false) AS lower,
                   coalesce(t.opens, false) AS opens, coalesce(t.either, false) AS either, p.before IS NOT NULL AS pair
            FROM ends2 e JOIN seen a ON a.w = e.last JOIN seen b ON b.w = e.first LEFT JOIN types s ON s.type = a.type LEFT JOIN types t ON t.type = b.type LEFT JOIN pairs p ON p.before = a.type AND p.type = b.type WHERE e.i > 0),
        told AS (
            SELECT r, i, mark OR CASE WHEN before = {_literal(punkt.DOTS)} OR (abbreviation AND NOT {_INITIAL.format('before')}) THEN coalesce(begins, starter AND coalesce(letter = 1, false))
                                      WHEN before = '#' OR {_INITIAL.format('before')} THEN NOT pair AND coalesce(begins, NOT ({_INITIAL.format('before')} AND coalesce(letter = 1, false) AND NOT lower)) ELSE true END AS ends
            FROM (SELECT *, CASE WHEN letter = 1 AND opens THEN true WHEN letter = 0 AND NOT either THEN false END AS begins FROM asked)),
        runs AS (SELECT u.r, u.i, u.u, sum(CASE WHEN t.ends THEN 1 ELSE 0 END) OVER (PARTITION BY u.r ORDER BY u.i) AS run FROM units u LEFT JOIN told t ON t.r = u.r AND t.i = u.i),
        cut AS (SELECT r, run, {_stripped("string_agg(u, '' ORDER BY i)")} AS sentence FROM runs GROUP BY r, run)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY r ORDER BY run) - 1 AS INTEGER) AS ord, sentence FROM cut JOIN d USING (r) WHERE sentence <> ''"""

ORACLES = {
    "punkt_sentences": _PUNKT,
    "maxmin_cached": f"SELECT doc_id, chunk_id, num_sentences, sentences_md5 FROM ({OWN['maxmin_documents']})",
    "auto_strategy": f"""
        WITH e AS (SELECT page_id, count(*) AS n FROM ({OWN['html_elements']}) GROUP BY page_id),
        s AS (SELECT page_id, CASE WHEN length(html) > 0 THEN length(regexp_replace(html, '<[^>]*>', '', 'g')) / length(html) ELSE 0.0 END AS share FROM pages)
        SELECT page_id, CASE WHEN share >= {SHARE} THEN 'fast' ELSE 'hi_res' END AS strategy, round(share, 6) AS share, CAST(CASE WHEN share >= {SHARE} THEN coalesce(n, 0) ELSE 1 END AS INTEGER) AS elements FROM s LEFT JOIN e USING (page_id)""",
    "reading_order": f"SELECT page_id, ord AS place, md5(text) AS text_md5 FROM ({OWN['html_elements']})",
    "punkt_types": f"WITH {_MODEL} SELECT type, abbreviation, starter, lower, opens, either FROM types",
}
