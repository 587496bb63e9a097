import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as X
from lectern.operators import reader

CHAPTERS = ["Cover", "Part 1", "Chapter 1", "Chapter 1", "Interlude", "Chapter 1", "Part 2", "Chapter 2", None, ""]


@pytest.fixture
def book(corpus):
    segments = [(100 + i, 1, i, c, f"text {i}") for i, c in enumerate(CHAPTERS, 1)]
    marks = [("Coda", "read me"), ("Coda", "   "), ("Ghost", "***"), ("Coda", "www.example.com/x"), ("Coda", "end")]
    segments += [(500 + i, 5, i, c, t) for i, (c, t) in enumerate(marks, 1)]
    return corpus([(1, "A", "1999", [])], [(1, 1, "en", "t"), (2, 1, "en", None), (3, 1, "en", "t"), (5, 1, "ja", "t")], segments)


def test_blocks(book):
    rows = reader.reader_blocks(book[0]).orderBy("edition_id", "block").collect()
    one = [(r.title, r.kind, r.segment_ids) for r in rows if r.edition_id == 1]
    assert one == [("Cover", "frontmatter", [101]), ("Part 1", "part", [102]), ("Chapter 1", "chapter", [103, 104]), ("Interlude", "other", [105]), ("Chapter 1", "chapter", [106]), ("Part 2", "part", [107]), ("Chapter 2", "chapter", [108]), (reader.UNTITLED, "backmatter", [109]), (reader.UNTITLED, "backmatter", [110])]
    assert [r.segment_ids for r in rows if r.edition_id == 5] == [[501, 505]]


def test_read(book):
    page = reader.read(*book, 1)
    assert page.target_id == 103 and page.current.title == "Chapter 1" and page.current.next_id == 105 and page.current.previous_id == 102
    page = reader.read(*book, 1, 104, highlights="103,999,104", query="text")
    assert page.primary_id == 104 and page.related_ids == [103]
    assert {r.id: r.parts is not None for r in page.segments.collect()} == {103: True, 104: True}
    for edition, segment, error in ((9, None, schema.EditionMissing), (2, None, schema.EditionNotIndexed), (3, None, schema.BlockMissing), (1, 501, schema.BlockMissing), (5, 502, schema.BlockMissing)):
        with pytest.raises(error):
            reader.read(*book, edition, segment)


def test_context(book):
    rows = reader.segment_context(*book, 102).collect()
    assert [r.id for r in rows] == list(range(101, 108)) and [r.id for r in rows if r.is_target] == [102]


def test_kinds(spark):
    cases = {"第十二章 羊": "chapter", "CHAPTER IV": "chapter", "part ii": "part", "第一部": "part", "目录": "frontmatter", "Also by X": "frontmatter", "謝辞": "backmatter", "What's next?": "backmatter", "Essay": "other", "Chapters": "other"}
    rows = spark.createDataFrame(list(cases.items()), "t string, k string").withColumn("got", X.title_kind(F.col("t")))
    assert rows.where("k <> got").collect() == []
