import duckdb

from lectern.queries import ORACLES, QUERIES


def test_references_that_are_cut_off(spark, tmp_path):
    pages = ["<h1>a &amp; b &amp</h1><li>c&#x27;d &lt;e&gt; &lt</li>", '<li><a href="/x?a=1&copy=2">f &quot;g&quot; &am</a></li><li>&amp;lt; &copy; &</li><li>&amp;amp</li>', "<h1>plain</h1><p>&copy;</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["html_items"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["html_items"](spark, str(tmp_path)).select(*names).collect())) == sorted(want.fetchall())
