"""What a page asks for by ids that may not be there, with an error for each that is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lectern import schema
from lectern.operators import reader, search, shelf


def work_row(works: DataFrame, work_id: int) -> Row:
    row = works.where(F.col("id") == work_id).first()
    if row is None:
        raise schema.WorkMissing(f"no work {work_id}")
    return row


def work_hits(segments: DataFrame, editions: DataFrame, works: DataFrame, query: str, work_id: int, language: str | None = None, genre: str | None = None) -> DataFrame:
    """All hits of a work by chapter. WorkMissing for an unknown work, then ValueError for an empty query."""
    work_row(works, work_id)
    if not (query or "").strip():
        raise ValueError("the query is empty")
    return search.group_chapters(search.search_work(segments, editions, works, query, work_id, language, genre))


def work_page(segments: DataFrame, editions: DataFrame, works: DataFrame, work_id: int) -> tuple[Row, DataFrame]:
    """A work and its editions with their number of segments, by language."""
    work = work_row(works, work_id)
    own = editions.where(F.col("work_id") == work_id)
    return work, shelf.edition_counts(own, segments.join(own.select(F.col("id").alias("edition_id")), "edition_id", "left_semi"))


def segment_page(segments: DataFrame, editions: DataFrame, works: DataFrame, segment_id: int) -> DataFrame:
    """A segment among those around it. SegmentMissing if there is none of that id."""
    if segments.where(F.col("id") == segment_id).isEmpty():
        raise schema.SegmentMissing(f"no segment {segment_id}")
    return reader.segment_context(segments, editions, works, segment_id)
