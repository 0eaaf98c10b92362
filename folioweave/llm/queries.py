"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import archives, decontaminate, language, neighbours, packing, passages, phrases, secrets, simhash, suffixes, tokens, toxicity, transactions
from folioweave.llm.common import table

TOKEN_LIMIT = 4096


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.Index(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return index.search(F.col("id") % 100 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archives.new_path(spark)
    archives.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    rows = archives.read(spark, path)
    as_id = lambda c: F.col(c).cast("long")
    return rows.select(as_id("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to_page").alias("refers_to"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = language.fold("doc_id", 5) == 0
    model = toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = decontaminate.benchmark_items(table(spark, sf_dir, "benchmark", "item_id", "text"))
    found = decontaminate.judged(decontaminate.find(docs, items))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = language.fold("doc_id", 4) == 2
    names, prototypes = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), names, prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    counts = (secrets.count("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS)
    return found.select("doc_id", *counts, F.sha2(secrets.listed("base").cast("binary"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op13_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.report(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


_OWN = (op1_neighbours, op2_token_counts, op3_warc, op4_toxicity, op5_decontaminate, op6_packing, op7_language, op8_passages, op9_simhash, op10_suffixes, op11_phrases, op12_secrets, op13_transactions)
QUERIES = {f.__name__: f for f in _OWN}

#: The primes of XXH64
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = f"{1 << 64}::UHUGEINT"


def _xxh64(texts: str, seed: int = simhash.SEED) -> str:
    """Rows (s, h) of the distinct texts ``s`` in ``texts`` and their XXH64.

    Numbers are wide enough for products, and brought below 2 ** 64 after them. To rotate by r is to multiply by 2 ** r
    modulo 2 ** 64 - 1. ``x`` has the bytes of a text in hex, the last one first.
    """
    wide = lambda n: f"{n % (1 << 64)}::UHUGEINT"
    rotated = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {wide((1 << 64) - 1)})"
    lane = lambda at, size: f"CAST(CAST('0x' || substr(x, 2 * (n - ({at}) - {size}) + 1, {2 * size}) AS UBIGINT) AS UHUGEINT)"
    product = lambda x, m: f"(({x}) * {wide(m)} % {_M})"
    turned = lambda acc, x: product(rotated(f"({acc} + {product(x, _P2)}) % {_M}", 31), _P1)
    starts = (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)
    sums = [f"list_reduce(list_prepend({wide(a)}, list_transform(range(0, n // 32), lambda k: {lane(f'32 * k + {8 * j}', 8)})), lambda acc, v: {turned('acc', 'v')}) AS a{j}" for j, a in enumerate(starts)]
    merged = "(" + " + ".join(rotated(f"a{j}", r) for j, r in enumerate((1, 7, 12, 18))) + f") % {_M}"
    for j in range(4):
        merged = f"((xor({merged}, {turned(wide(0), f'a{j}')}) * {wide(_P1)} + {wide(_P4)}) % {_M})"
    step = lambda x, r, m, a: f"{{'h': {wide(0)}, 'x': {x}, 'r': {wide(1 << r)}, 'm': {wide(m)}, 'a': {wide(a)}}}"
    eights = f"list_transform(range(0, n % 32 // 8), lambda k: {step(turned(wide(0), lane('n - n % 32 + 8 * k', 8)), 27, _P1, _P4)})"
    fours = f"list_transform(range(0, n % 8 // 4), lambda k: {step(product(lane('n - n % 8', 4), _P1), 23, _P2, _P3)})"
    ones = f"list_transform(range(0, n % 4), lambda k: {step(product(lane('n - n % 4 + k', 1), _P5), 11, _P1, 0)})"
    first = f"{{'h': (h + CAST(n AS UHUGEINT)) % {_M}, 'x': {wide(0)}, 'r': {wide(0)}, 'm': {wide(0)}, 'a': {wide(0)}}}"
    taken = f"{{'h': (xor(t.h, o.x) * o.r % {wide((1 << 64) - 1)} * o.m + o.a) % {_M}, 'x': o.x, 'r': o.r, 'm': o.m, 'a': o.a}}"
    return f"""
        SELECT s, CAST(xor(h, h // {wide(1 << 32)}) AS UBIGINT) AS h FROM (
        SELECT s, xor(h, h // {wide(1 << 29)}) * {wide(_P3)} % {_M} AS h FROM (
        SELECT s, xor(h, h // {wide(1 << 33)}) * {wide(_P2)} % {_M} AS h FROM (
        SELECT s, list_reduce(list_concat([{first}], {eights}, {fours}, {ones}), lambda t, o: {taken}).h AS h FROM (
        SELECT s, x, n, CASE WHEN n >= 32 THEN {merged} ELSE {wide(seed + _P5)} END AS h FROM (
        SELECT s, x, n, {', '.join(sums)} FROM (
        SELECT s, CAST(octet_length(encode(s)) AS BIGINT) AS n, array_to_string(list_reverse(regexp_extract_all(hex(encode(s)), '..')), '') AS x FROM (SELECT DISTINCT s FROM {texts})))))))"""


_SIMHASH = rf"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - {simhash.WORDS - 1}) + 1), lambda i: array_to_string(w[i:i + {simhash.WORDS - 1}], ' '))) AS s FROM d WHERE len(w) > 0),
        h AS MATERIALIZED ({_xxh64('p')}),
        f AS MATERIALIZED (
            SELECT doc_id, coalesce(v, 0 :: UBIGINT) AS v FROM d LEFT JOIN (
                SELECT doc_id, CAST({' + '.join(f'CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k}::HUGEINT ELSE 0 END' for k in range(64))} AS UBIGINT) AS v
                FROM p JOIN h USING (s) GROUP BY doc_id) USING (doc_id)),
        g AS MATERIALIZED (SELECT v, min(doc_id) AS least FROM f GROUP BY v),
        links AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM g a JOIN g b ON bit_count(xor(a.v, b.v)) <= {simhash.NEAR} AND a.v <> b.v),
        r AS (SELECT v AS root, v FROM g UNION SELECT r.root, links.b FROM r JOIN links ON r.v = links.a)
        SELECT doc_id, printf('%016x', f.v) AS fingerprint, c.component_id FROM f JOIN (SELECT root AS v, min(least) AS component_id FROM r JOIN g USING (v) GROUP BY root) c USING (v)"""

_PHRASES = r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
        longer AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS held FROM c, (VALUES (1), (2)) t(i) WHERE k = 3 GROUP BY ALL),
        stay AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * a),
        cuts AS (SELECT s.lang, s.phrase, s.a, i, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * s.a * s.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
                 FROM stay s JOIN (VALUES (1), (2)) t(i) ON i < s.k
                 JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:i], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[i + 1:s.k], ' ')),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) QUALIFY rank <= 2000"""


def _secrets() -> str:
    either = lambda m: f"[{m[0].upper()}{m[0]}]"
    plain = {k: re.sub("[a-z]", either, v[: v.index(")")].replace("(?i:", "(")) + v[v.index(")") :] if k == "assign" else v for k, v in secrets.KINDS.items()} | {"opaque": secrets.OPAQUE}
    quoted = {k: v.replace("'", "''") for k, v in plain.items()}
    order, n = {k: i for i, k in enumerate(secrets.ORDER)} | {"opaque": -1}, "len(list_distinct(regexp_extract_all(v, '(?s).')))"
    kinds = " UNION ALL ".join(
        f"SELECT r, doc_id, source, {order[k]} AS kind, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS m, unnest(g[:len(m)]) AS gap FROM (SELECT *, regexp_extract_all(t, '{p}') AS m, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS g FROM d)"
        for k, p in quoted.items()
    )
    least = " ".join(f"WHEN {order[k]} THEN length(v) >= {x}" for k, x in secrets.LEAST.items())
    named = " ".join(f"WHEN {i} THEN '{k}'" for k, i in order.items() if i >= 0)
    listing = f"string_agg((CASE kind {named} END) || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {order[k]}) AS BIGINT) AS n_{k}" for k in secrets.KINDS)
    return rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
        m AS ({kinds}),
        x AS (SELECT r, doc_id, source, kind, m, CASE WHEN kind = 0 THEN regexp_extract(m, '{quoted['assign']}', 2) ELSE m END AS v,
                     CAST(sum(gap + length(m)) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS e FROM m),
        y AS MATERIALIZED (SELECT *, regexp_matches(v, '[0-9]') AS digit, regexp_matches(v, '[A-Z]') AS upper, regexp_matches(v, '[a-z]') AS lower FROM x
              WHERE CASE kind {least} ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND NOT regexp_matches(v, '{secrets.WORDLIKE}') END),
        o AS (SELECT v, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners FROM y GROUP BY v),
        base AS (SELECT r, kind, e - length(m) AS s, e FROM y WHERE kind >= 0),
        more AS (SELECT DISTINCT r, CASE WHEN owners >= {secrets.EXAMPLE} THEN {order['example']} ELSE {order['live']} END AS kind, e - length(v) AS s, e FROM y JOIN o USING (v)
                 WHERE owners >= {secrets.EXAMPLE} OR (digit AND (upper OR lower) AND {n} >= {secrets.VARIED})),
        b AS (SELECT r, {counts}, {listing} AS spans FROM base GROUP BY r),
        a AS (SELECT r, {listing} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY r)
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.KINDS)}, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
        FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""


def _crc32(blob: str) -> str:
    """The CRC-32 of a blob: bytes in turn, and for each bit of one a polynomial."""
    bits = []
    for j in range(8):
        c = 1 << j
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        bits.append(c)
    x = "(xor(acc, v) & 255)"
    step = "acc >> 8"
    for j, c in enumerate(bits):
        step = f"xor({step}, (({x} >> {j}) & 1) * {c})"
    values = f"list_transform(range(1, octet_length({blob}) + 1), lambda i: CAST('0x' || hex({blob}[i:i]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda acc, v: {step}), 4294967295)"


_TRANSACTIONS = f"""
        WITH d AS MATERIALIZED (SELECT doc_id AS id, source, text, {_crc32('encode(CAST(doc_id AS VARCHAR))')} AS h FROM documents WHERE doc_id IS NOT NULL),
        o AS (SELECT *, CASE WHEN h % 23 < 2 THEN 0 WHEN h % 23 < 3 THEN 1 WHEN h % 23 < 5 THEN 2 WHEN h % 23 < 7 THEN 3 ELSE 4 END AS op, h // 100 % 300 AS key FROM d),
        b AS MATERIALIZED (SELECT id, encode(key || ':' || text) AS body FROM o WHERE op = 4 AND text IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
        v AS MATERIALIZED (SELECT id, {_crc32('body')} AS crc FROM b),
        t AS (SELECT *, coalesce(sum(CASE WHEN op < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tx,
                     sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) OVER (ORDER BY id) AS nth, coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '+' END AS src FROM o),
        s AS (SELECT *, sum(CASE op WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER (PARTITION BY src, tx ORDER BY id) AS x FROM t),
        p AS (SELECT *, x - least(0, min(x) OVER (PARTITION BY src, tx ORDER BY id)) AS depth FROM s),
        q AS MATERIALIZED (SELECT *, coalesce(lag(depth) OVER (PARTITION BY src, tx ORDER BY id), 0) AS was FROM p),
        u AS (SELECT c.id, min(r.id) AS by_id FROM q c JOIN q r ON r.src = c.src AND r.tx = c.tx AND r.op = 3 AND c.op = 4 AND r.id > c.id AND r.was <= c.depth GROUP BY c.id),
        f AS MATERIALIZED (SELECT c.id, c.key, u.by_id, e.op AS ended, e.id AS end_id, e.nth AS nth FROM q c LEFT JOIN u USING (id) LEFT JOIN q e ON e.src = c.src AND e.tx = c.tx AND e.op < 2 WHERE c.op = 4),
        k AS MATERIALIZED (SELECT id, key, nth, (nth - 1) // 4 + 1 AS epoch FROM f WHERE by_id IS NULL AND ended = 0),
        n AS (SELECT unnest(range(1, CAST((max(nth) + 3) // 4 AS BIGINT) + 1)) AS epoch FROM q WHERE op = 0),
        l AS (SELECT n.epoch, k.key, k.id FROM n JOIN k ON k.epoch <= n.epoch QUALIFY row_number() OVER (PARTITION BY n.epoch, k.key ORDER BY k.nth DESC, k.id DESC) = 1)
        SELECT 'state' AS kind, n.epoch AS id, count(v.id) AS n, CAST(coalesce(sum(v.crc), 0) AS BIGINT) AS value FROM n LEFT JOIN l ON l.epoch = n.epoch LEFT JOIN v ON v.id = l.id GROUP BY n.epoch
        UNION ALL SELECT CASE WHEN by_id IS NOT NULL THEN 'rollback' ELSE 'abort' END, id, coalesce(by_id, end_id), CAST(key AS BIGINT) FROM f WHERE by_id IS NOT NULL OR coalesce(ended, 1) = 1"""

ORACLES = {
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
        d AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS h FROM p),
        g AS (SELECT h, max(page_id) AS target FROM d WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY h)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
               CASE WHEN d.n >= 1000 AND g.target <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.n >= 1000 AND g.target <> d.page_id THEN g.target END AS refers_to
        FROM d LEFT JOIN g ON d.h = g.h""",
    "op5_decontaminate": r"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS s
               FROM b WHERE len(w) > 0),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
               FROM d, ks WHERE len(w) >= k),
        hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
        cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM hits GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_passages": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS h
              FROM d WHERE len(w) >= 13),
        m AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN m USING (h) WHERE m.first < s.doc_id),
        g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN g.n IS NULL THEN array_to_string(w, ' ')
                           ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ps, k)), lambda k: w[k]), ' '), '') END) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op9_simhash": _SIMHASH,
    "op11_phrases": _PHRASES,
    "op12_secrets": _secrets(),
    "op13_transactions": _TRANSACTIONS,
    "op10_suffixes": """
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        s AS (SELECT r, unnest(range(1, n - 198)) AS i, b FROM d WHERE n >= 200),
        c AS (SELECT r, i, count(*) OVER (PARTITION BY w) AS times FROM (SELECT r, i, b[i:i + 199] AS w FROM s)),
        g AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
              FROM (SELECT r, i, lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) AS before FROM c WHERE times > 1)),
        runs AS (SELECT r, run, min(i) AS first, max(i) + 199 AS last FROM g GROUP BY r, run),
        cuts AS (SELECT r, list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts, sum(last - first + 1) AS gone, count(*) AS spans FROM runs GROUP BY r),
        k AS (SELECT doc_id, n, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans,
                     array_to_string(list_transform(range(1, CAST(coalesce(spans, 0) AS BIGINT) + 2), lambda j: hex(b[coalesce(lasts[j - 1], 0) + 1:coalesce(firsts[j], n + 1) - 1])), '') AS kept
              FROM d LEFT JOIN cuts USING (r))
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k""",
}
