import pytest
from pyspark.sql import functions as F

from folioweave.functions import cleaning
from folioweave.functions.patterns import BLANKS, S

VECTORS = [
    ("\nPage 1\nIni adalah contoh     teks.\n\n\nDengan whitespace    berlebih.\n", "Ini adalah contoh teks.\nDengan whitespace berlebih."),
    ("Page 1\n\nIni teks     dengan    spasi.\n\n\n", "Ini teks dengan spasi."),
    ("kalimat pertama\nlanjut", "kalimat pertama lanjut"),
    ("A.\n-5.2", "A.\n5.2"),
    ("a\n12\nb", "a b"),
    ("x [3] y (12) z", "x y z"),
    ("lihat https://a.b/c?d=1~e", "lihat ~e"),
    ("a.....b", "a...b"),
    ("a---b", "ab"),
    ("a \t b", "a   b"),
    ("Copyright © 2024 X\nz", "Copyright z"),
    ("Halaman 1 of 10", "of 10"),
    ("Para satu.\n\nPara dua.", "Para satu.\nPara dua."),
    (None, ""),
    ("", ""),
    ("mail a@b.com ok", "mail ok"),
    ("• item\n● dua", "item dua"),
    ("a --- b", "a  b"),
    ("a\nb\nc\nd", "a b c d"),
    ("　\x1cx\u0085", "x"),
]


def _run(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, text string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("text"))).collect()]


def test_clean_text(spark):
    assert _run(spark, [v for v, _ in VECTORS], cleaning.clean_text) == [w for _, w in VECTORS]


def test_very_long_addresses_do_not_overflow(spark):
    assert _run(spark, ["x https://a.b/" + "c" * 300_000 + " y"], cleaning.clean_text) == ["x y"]


def test_advanced(spark):
    assert _run(spark, ["a 12 b"], lambda c: cleaning.clean_text_advanced(c, remove_numbers=True)) == ["a b"]
    assert _run(spark, ["a, b!"], lambda c: cleaning.clean_text_advanced(c, remove_punctuation=True)) == ["a b"]
    assert _run(spark, ["a, 12", None], cleaning.clean_text_advanced) == ["a, 12", ""]


def test_headers(spark):
    text = "Badan Pusat Statistik RI\nISI"
    assert _run(spark, [text, "x\nkatalog no: 1"], cleaning.remove_headers_footers) == ["ISI", "x"]
    assert _run(spark, [text], lambda c: cleaning.remove_headers_footers(c, ["^isi$"])) == ["Badan Pusat Statistik RI"]


def test_reduction(spark):
    rows = spark.createDataFrame([("abcd", "ab"), ("", ""), (None, "")], "a string, b string")
    assert [r[0] for r in rows.select(cleaning.reduction_percent(F.col("a"), F.col("b"))).collect()] == [50.0, 0.0, 0.0]


@pytest.mark.parametrize(("name", "want"), [("a/b.c.pdf", "b.c"), ("x", "x"), (".hidden", ".hidden")])
def test_stem(spark, name, want):
    assert _run(spark, [name], cleaning.stem) == [want]


def test_pages(spark):
    rows = spark.createDataFrame([(["a", " \n", "b"],), ([],), (None,)], "pages array<string>")
    assert [r[0] for r in rows.select(cleaning.join_pages(F.col("pages"))).collect()] == ["a\nb", "", None]


def test_rewrites_that_a_text_does_not_need_are_passed_over(spark):
    """Each rewrite alone and all together give what the bare patterns give, where they are needed and where not."""
    texts = [v for v, _ in VECTORS] + ["Page 1 Halaman 2 3 of 4 http://a.b mail a@b.cd\n[1]\n [2] (3) © 2020 x\nCopyright 2021\n\n\n\t a  b...... --- ___ ====\nc\ufeff\u200b\u200c\u200d", *(f"x{n}y" for x in cleaning.NEEDS.values() for n in x)]
    bare = lambda t: F.regexp_replace(cleaning._rewritten(F.coalesce(t, F.lit("")), [(p, r) for _, p, r in cleaning.REWRITES]), f"^{S}+|{S}+\\z", "")
    assert _run(spark, texts, cleaning.clean_text) == _run(spark, texts, bare)
    assert set(cleaning.NEEDS) <= {n for n, _, _ in cleaning.REWRITES}


def test_strip_knows_every_blank(spark):
    texts = [b + "x" + b + "y" + b for b in (*BLANKS, BLANKS)] + ["", BLANKS, "\u200bx", None]
    assert _run(spark, texts, cleaning.strip) == _run(spark, texts, lambda t: F.regexp_replace(t, f"^{S}+|{S}+\\z", ""))
    found = spark.range(1).select(cleaning.clean_text(F.lit("x"))).select("*")
    assert "contains(" in found._jdf.queryExecution().analyzed().toString().lower()
