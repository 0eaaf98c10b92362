import duckdb
import pytest

import __spark_entry__ as entry
from folioweave import queries, queries_search, queries_text

QUERIES = queries.QUERIES | queries_text.QUERIES | queries_search.QUERIES
ORACLES = queries.ORACLES | queries_text.ORACLES | queries_search.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark, small):
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and all(r["chunks"] > 0 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_maxmin_forms_agree(spark, small):
    rows = [sorted(map(tuple, queries._clusters(spark, small, impl, fixed_threshold=t).collect())) for t in (0.6, 0.05, -1.0) for impl in ("arrow", "hof")]
    assert rows[0] == rows[1] and rows[2] == rows[3] and rows[4] == rows[5]


def test_windows_are_the_splitter_for_one_empty_separator(spark, small):
    a, b = (sorted(map(tuple, q(spark, small).collect())) for q in (queries.recursive_windows, queries.recursive_chunks_characters))
    assert a == b


PAGES = [
    *(f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>&copy; a &quot;b&quot; &amp;quot; c {t}<br>d</body></html>" for t in ("t = &quot", "t = &quot;", "t = &quo", "&", "&amp", "&am", "&ampx", "&copy", "&quotation; x", "&middotx", "&nothing;", "R&D", "a &quot b")),
    '<nav><ul><li><a href="/x?a=1&copy=2&quot">x</a></li></ul></nav><p>y',
    "",
]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Elements' queries against their SQL on pages with references that lack their ends."""
    path = str(tmp_path_factory.mktemp("cut"))
    con = duckdb.connect()

    def check(name, pages=tuple(PAGES)):
        folder = f"{path}/{name}-{len(pages)}"
        spark.createDataFrame([(k, f"https://a.example/{k}", page) for k, page in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        rows = QUERIES[name](spark, folder).select(*names).collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(result.fetchall(), key=repr)

    return check


@pytest.mark.parametrize("name", ["html_elements", "element_chunks", "reading_order"])
def test_references_without_a_semicolon_are_those_of_the_sql(name, cut_pages):
    cut_pages(name)


def test_sizes_count_references_as_the_sql_does(cut_pages):
    cut_pages("element_size_stats")
    cut_pages("element_size_stats", ("<h1>t = &quot</h1>",))


def test_texts_of_pages_without_content_are_none(cut_pages):
    cut_pages("element_text_list")
    cut_pages("element_text_list", ("<p>a &quot", None, "", "<p>&amp"))
