import duckdb
import pytest

from lectern.queries import ORACLES, QUERIES

TEXT = "0997 first\n1232 second\n  2 3 third 2 \nx\n\n5 sixth 5\n 666\n7\n18 ninth 8\n9 tenth"  # lines that begin or end with the digits of their place


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    rows = [(1, TEXT, "de", "src1", len(TEXT)), (12, "0\n11 the thing 1\n1111", "en", "src3", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["drop_folder", "epub_continued", "epub_fragments", "epub_headings", "epub_markers", "epub_nav", "epub_ncx", "search_latin", "highlight_parts", "indexed_search", "repair_alignment"])
def test_digits_at_the_ends_of_lines_stay(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, tables).select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
