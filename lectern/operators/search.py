"""Full-text search over segments with a token column.

The predicate is a substring test inside codegen; works and editions are joined as Spark sizes them. The top-k of each work uses a
window whose limit Spark applies before the shuffle, and counts that are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

PER_WORK, LIMIT = 30, 100


def hits(segments: DataFrame, editions: DataFrame, works: DataFrame, query: str, language: str | None = None, genre: str | None = None, work_id: int | None = None) -> DataFrame:
    """All hits of a query, with their edition's and work's columns. Filters left empty do not filter; an unusable query has no hits."""
    found = segments.where(X.matches(F.col("tok"), query)).select(F.col("id").alias("segment_id"), "edition_id", "content", "chapter", "page", "seq")
    e = editions.select(F.col("id").alias("edition_id"), "work_id", "language", "format")
    w = works.select(F.col("id").alias("work_id"), "title_zh", "title_ja", "title_en", "year", "genres")
    if language:
        e = e.where(F.col("language") == language)
    if genre:
        w = w.where(F.array_contains("genres", genre))
    if work_id is not None:
        e = e.where(F.col("work_id") == work_id)
    return found.join(e, "edition_id").join(w, "work_id")


def asked_of(segments: DataFrame, query: str) -> DataFrame:
    """Segments that can match, by a test that costs less than making their tokens. For segments whose tok is not stored."""
    return segments.where(X.may_match(F.col("content"), query))


def reading_order() -> list[Column]:
    return [F.asc_nulls_first("year"), F.asc("language"), F.asc("seq"), F.asc("edition_id"), F.asc("segment_id")]


def search(segments, editions, works, query, language=None, genre=None, limit: int = LIMIT) -> DataFrame:
    """The first hits in order of year, language and place."""
    return hits(segments, editions, works, query, language, genre).orderBy(*reading_order()).limit(limit)


def search_grouped(segments, editions, works, query, language=None, genre=None, per_work: int = PER_WORK) -> DataFrame:
    """At most per_work hits of each work, with total_hits: how many it has after the filters."""
    h = hits(segments, editions, works, query, language, genre)
    if per_work <= 0:
        return h.withColumn("total_hits", F.lit(0).cast("long")).limit(0)
    order = Window.partitionBy("work_id").orderBy("language", "seq", "edition_id", "segment_id")
    top = h.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= per_work)
    totals = h.groupBy("work_id").agg(F.count("*").alias("total_hits"))
    return top.join(totals, "work_id").drop("hit_rank")


def search_work(segments, editions, works, query, work_id: int, language=None, genre=None) -> DataFrame:
    return hits(segments, editions, works, query, language, genre, work_id).orderBy("language", "seq", "edition_id", "segment_id")


def group_works(grouped: DataFrame) -> DataFrame:
    """A row for each work of search_grouped(): totals, how many are shown, and its first hit's place, by which works are ordered."""
    first = F.min(F.struct("year", "language", "seq", "edition_id", "segment_id"))
    out = grouped.groupBy("work_id", "title_zh", "year").agg(F.max("total_hits").alias("total_hits"), F.count("*").alias("displayed_hits"), first.alias("first"))
    return out.withColumn("is_truncated", F.col("displayed_hits") < F.col("total_hits")).orderBy("first").drop("first")


def group_chapters(rows: DataFrame, most_ids: int = X.HIGHLIGHTS_MOST) -> DataFrame:
    """Hits by edition and chapter (null and empty are one), each group's in order of place, groups in order of their first hit.

    Give it the hits of a page: search_grouped() bounds them per work, search_work() is one work's.
    """
    chapter = F.when(F.col("chapter") != "", F.col("chapter"))
    hit = F.struct("seq", "segment_id")
    g = rows.groupBy("edition_id", "language", chapter.alias("chapter")).agg(
        F.array_sort(F.collect_list(hit)).alias("hits"),
        F.min(F.struct("year", "language", "seq", "edition_id", "segment_id")).alias("first"),
    )
    ids = F.transform("hits", lambda h: h["segment_id"])
    return g.select(
        "edition_id", "language", "chapter", X.chapter_key(F.col("edition_id"), F.col("chapter")).alias("chapter_key"),
        F.get("hits", F.lit(0))["segment_id"].alias("primary_segment_id"), F.slice(ids, 2, 2_000_000_000).alias("additional_segment_ids"),
        F.size("hits").alias("chapter_hit_count"), ids.alias("all_segment_ids"),
        F.array_join(F.slice(F.transform(ids, lambda i: i.cast("string")), 1, most_ids), ",").alias("highlights_param"),
        (F.size("hits") > 1).alias("is_multi_hit"), "first",
    ).orderBy("first").drop("first")
