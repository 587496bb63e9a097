from pyspark.sql import functions as F

from lectern import book_queries
from lectern.functions import text as X

TEXTS = [*map(chr, range(256)), "Of The THING", "thing of\tthe 12x_3-4", "\x00a\x1cb\x7fc", "", None, "für Thing", "羊男 of the", "K Å ſ İ i̇", "é x"]


def test_the_short_way_for_ascii_gives_the_same(spark):
    source, target = X.fold_table()
    c = F.col("c")
    whole = F.regexp_extract_all(F.translate(F.lower(X.cjk_space(F.coalesce(c, F.lit("")))), source, target), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(f"{t} thing of the",) for t in TEXTS], "c string")
    assert rows.where(~X.tokens(c).eqNullSafe(whole)).count() == 0
    asked = rows.where(X.matches(X.token_text(c), 'thing "of the"'))
    assert asked.count() > 200 and asked.where(~X.may_match(c, 'thing "of the"')).count() == 0


def test_an_indexed_search_makes_tokens_of_few_segments(spark):
    plan = book_queries.indexed_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    tested = [line for line in plan.splitlines() if "Filter" in line and "Contains(" in line]
    assert tested and all("Contains(CASE WHEN" in line for line in tested)  # the folded text is asked before the tokens
