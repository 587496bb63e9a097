import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import sql
from lectern.functions import text as X
from lectern.operators import index, pages, search

TEXTS = ["羊男在图书馆", "羊の男", "羊 男", "カフカ・海辺", "ab羊cd", "羊男井户", "羊男 and 井户", "Café", "CAFÉ noir", "don't stop", "foo_bar", "well-known", "well known", "Straße", "ångström", "ǖ x", "σίσυφος", "й", "x\u0323y z", "x\u0338y z", "water only", "not water", "water running", "running water", "ΣΊΣΥΦΟΣ", "ế", "1２3", "ﬁn", "𠮷野家", "か\u3099", "foo & bar", "*** !", "wat"]
QUERIES = ["羊男", "羊　男", "男", "カフカ海辺", "ab羊", "b羊", "cafe", "CAFÉ", "noir cafe", "don't", "foo", "well-known", "straße", "strasse", "angstrom", "ü", "σισυφος", "й", "xy", "x y", "NOT water", "wat*", "water running", "野家", "か", "foo & bar", "foo ***", "、", "123", "fin"]


@pytest.mark.parametrize("chunk", [0, 1, 2])
def test_same_hits_as_fts5(spark, chunk):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5 here")
    space = lambda t: re.sub(f"([{X.CJK.pattern[1:-1]}])", r" \1 ", t)
    con.executemany("INSERT INTO f(rowid, body) VALUES (?, ?)", [(i, space(t)) for i, t in enumerate(TEXTS)])
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string").withColumn("tok", X.token_text(F.col("content"))).cache()
    for q in QUERIES[chunk::3]:
        parts = [space(q)] if X.CJK.search(q) else q.split()
        want = {r[0] for r in con.execute("SELECT rowid FROM f WHERE f MATCH ?", (" AND ".join(f'"{p}"' for p in parts),))}
        assert {r.id for r in rows.where(X.matches(F.col("tok"), q)).collect()} == want, q


def small(corpus):
    works = [(12, "A", "2002", ["essay"]), (27, "B", "1987", ["novel"]), (30, "C", None, ["novel", "essay"])]
    editions = [(120, 12, "zh", "t"), (121, 12, "en", "t"), (270, 27, "zh", "t"), (300, 30, "en", None)]
    segments = [(1201, 120, 3, "一", "needle one"), (1202, 120, 1, "一", "needle two"), (1203, 120, 2, "", "needle three"), (1211, 121, 1, None, "a Needle"), (3001, 300, 1, "x", "needless")]
    segments += [(2700 + i, 270, i, "c", f"needle {i}") for i in range(1, 206)]
    return corpus(works, editions, segments)


def test_order_limit_and_filters(corpus):
    c = small(corpus)
    found = [r.segment_id for r in search.search(*c, "needle", limit=500).collect()]
    assert found[0] == 2701 and found[-4:] == [1211, 1202, 1203, 1201] and len(found) == 209
    assert [r.segment_id for r in search.search(*c, "needle", language="en").collect()] == [1211]
    assert {r.work_id for r in search.search(*c, "needle", genre="essay").collect()} == {12}
    assert search.search(*c, "").count() == 0 and search.search(*c, "needle ***").count() == 0
    assert [r.segment_id for r in search.search_work(*c, "needle", 12).collect()] == [1211, 1202, 1203, 1201]


def test_groups_keep_full_counts(corpus):
    c = small(corpus)
    g = search.search_grouped(*c, "needle").cache()
    works = search.group_works(g).collect()
    assert [(w.work_id, w.total_hits, w.displayed_hits, w.is_truncated) for w in works] == [(27, 205, 30, True), (12, 4, 4, False)]
    assert search.search_grouped(*c, "needle", language="en").first().total_hits == 1
    assert search.search_grouped(*c, "needle", per_work=0).count() == 0
    rows = {(r.edition_id, r.chapter): r for r in search.group_chapters(g).collect()}
    assert rows[120, "一"].all_segment_ids == [1202, 1201] and rows[120, "一"].highlights_param == "1202,1201" and rows[120, "一"].is_multi_hit
    assert rows[120, None].primary_segment_id == 1203 and len({r.chapter_key for r in rows.values()}) == len(rows)


def test_kwic_matches_python(spark):
    text = "Water wafts; underwater WATER, waterfall water. " * 3
    one = lambda q, t, **k: [tuple(x) for x in spark.createDataFrame([(t,)], "t string").select(X.kwic(F.col("t"), q, **k).alias("k")).first().k]
    want = [(text[max(0, m.start() - 9) : m.start()], m[0], text[m.end() : m.end() + 9]) for m in re.finditer(r"(?<!\w)water(?!\w)", text, re.I)]
    assert one("water", text, width=9) == want[:5] and len(want) == 9
    assert one("cafe", "Café") == [] and one("a.b*", "xa.b* a.b*")[0][1] == "a.b"
    assert one("running water", "I am\nrunning water")[0][1] == "running"
    parts = spark.createDataFrame([("a water b",)], "t string").select(X.highlight_parts(F.col("t"), "water").alias("p")).first().p
    assert [tuple(p) for p in parts] == [("a ", False), ("water", True), (" b", False)]


def test_display_terms_and_ids(spark):
    assert X.display_terms('"running water" AND Norwegian norwegian wood.') == ["running water", "Norwegian", "wood"]
    assert X.display_terms("羊男 井户") == ["羊男 井户"] and X.display_terms("  ") == []
    ids = "1,1,bad,-2,３," + ",".join(map(str, range(2, 260)))
    got = spark.createDataFrame([(ids,)], "t string").select(X.highlight_ids(F.col("t")).alias("v")).first().v
    assert got == list(range(1, 201))


@pytest.mark.parametrize("chunk", [0, 1, 2])
def test_the_cheap_test_passes_every_hit(spark, chunk):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string").withColumn("tok", X.token_text(F.col("content"))).cache()
    for q in QUERIES[chunk::3]:
        assert rows.where(X.matches(F.col("tok"), q) & ~X.may_match(F.col("content"), q)).count() == 0, q
    assert rows.where(X.may_match(F.col("content"), "water")).count() == 4


def test_postings_narrow_to_all_hits(spark, corpus, tmp_path):
    segments, editions, works = small(corpus)
    index.write_postings(segments, str(tmp_path / "p"))
    for q in ("needle", "needle one", '"needle one"', "needle nothing", "***", "", "NEEDLE 17"):
        want = {r.segment_id for r in search.hits(segments, editions, works, q).collect()}
        assert {r.segment_id for r in search.hits(index.narrowed(segments, str(tmp_path / "p"), q), editions, works, q).collect()} == want, q
    plan = index.candidates(spark, str(tmp_path / "p"), "needle")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_pages_of_ids_that_are_not_there(corpus):
    c = small(corpus)
    assert pages.work_hits(*c, "needle", 12).count() == 3 and pages.segment_page(*c, 1202).where("is_target").count() == 1
    work, editions = pages.work_page(*c, 12)
    assert work["title_zh"] == "A" and [(r.id, r.segment_count) for r in editions.collect()] == [(121, 1), (120, 3)]
    for call, error in ((lambda: pages.work_hits(*c, "", 99), schema.WorkMissing), (lambda: pages.work_hits(*c, "  ", 12), ValueError), (lambda: pages.work_page(*c, 99), schema.WorkMissing), (lambda: pages.segment_page(*c, 5), schema.SegmentMissing)):
        with pytest.raises(error):
            call()


def test_ends_of_display_terms():
    assert X.display_terms('(wat*) "running water" not near [x].\\ «y»') == ["running water", "wat", "x", "«y»"]
    assert X.display_terms('"two\nlines" z') == ['two', 'lines', 'z'] and X.display_terms("羊男。") == ["羊男。"] and X.display_terms("羊男!") == ["羊男"]


def test_sql_functions_are_the_column_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(i, t, [None, "", "II"][i % 3], [None, 0, 7][i % 3], ["zh", "ja", "xx"][i % 3]) for i, t in enumerate([*TEXTS, None, " www.example.com/x ", "…"])], "id long, t string, chapter string, page int, lang string")
    rows.createOrReplaceTempView("samples")
    got = spark.sql("SELECT id, cjk_space(t), token_text(t), locator(page, chapter, CAST(id AS INT)), chapter_key(id, chapter), language_label(lang), readable(t) FROM samples").collect()
    t = F.col("t")
    want = rows.select("id", X.cjk_space(t), X.token_text(t), X.locator(F.col("page"), F.col("chapter"), F.col("id").cast("int")), X.chapter_key(F.col("id"), F.col("chapter")), X.language_label(F.col("lang")), X.readable(t)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SELECT count(*) FROM samples WHERE contains(token_text(t), token_text('羊　男'))").first()[0] == rows.where(X.matches(X.token_text(t), "羊　男")).count() > 0
