"""Reading: contiguous chapter blocks of editions, their kinds and neighbours.

Everything is partitioned by edition: one shuffle, or none after a write bucketed by edition_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as X

UNTITLED = "未标注章节"


def reader_blocks(segments: DataFrame) -> DataFrame:
    """A row for each run of readable segments of one chapter (null and empty are different chapters).

    Unreadable segments go first, so a chapter that only a placeholder interrupts stays one block. Titles of no other kind before
    an edition's first chapter are front matter, after its last one back matter.
    """
    order = Window.partitionBy("edition_id").orderBy("seq", "id")
    rows = segments.where(X.readable(F.col("content"))).select("edition_id", "id", "seq", "chapter")
    fresh = (F.row_number().over(order) == 1) | ~F.col("chapter").eqNullSafe(F.lag("chapter").over(order))
    runs = rows.withColumn("block", F.sum(F.when(fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = runs.groupBy("edition_id", "block").agg(
        F.first("chapter").alias("chapter"), F.min_by("id", F.struct("seq", "id")).alias("first_segment_id"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("segment_ids"),
    )
    whole = Window.partitionBy("edition_id")
    kind = X.title_kind(F.col("chapter"))
    blocks = blocks.withColumn("kind", kind)
    at = F.when(F.col("kind") == "chapter", F.col("block"))
    first, last = F.min(at).over(whole), F.max(at).over(whole)
    placed = F.when((F.col("kind") == "other") & (F.col("block") < first), "frontmatter").when((F.col("kind") == "other") & (F.col("block") > last), "backmatter").otherwise(F.col("kind"))
    title = F.when(F.length("chapter") > 0, F.col("chapter")).otherwise(UNTITLED)
    return blocks.withColumns({"kind": placed, "title": title}).select("edition_id", (F.col("block") - 1).cast("int").alias("block"), "title", "chapter", "kind", "first_segment_id", "first_seq", "last_seq", "segment_ids")


def default_blocks(blocks: DataFrame) -> DataFrame:
    """The block each edition opens at: its first chapter, or its first block."""
    return blocks.groupBy("edition_id").agg(F.min_by("first_segment_id", F.struct(F.col("kind") != "chapter", "block")).alias("segment_id"))


def navigation(blocks: DataFrame) -> DataFrame:
    """Blocks with the first segments of the previous and the next one."""
    order = Window.partitionBy("edition_id").orderBy("block")
    return blocks.withColumns({"previous_id": F.lag("first_segment_id").over(order), "next_id": F.lead("first_segment_id").over(order)})


def segment_context(segments: DataFrame, editions: DataFrame, works: DataFrame, segment_id: int, reach: int = 5) -> DataFrame:
    """The segments of the same edition within reach places, the target marked."""
    target = segments.where(F.col("id") == segment_id).select("edition_id", F.col("seq").alias("at"))
    near = segments.join(target, "edition_id").where(F.col("seq").between(F.col("at") - reach, F.col("at") + reach))
    e = editions.select(F.col("id").alias("edition_id"), "work_id", "language")
    w = works.select(F.col("id").alias("work_id"), "title_zh")
    return near.join(e, "edition_id").join(w, "work_id").select("id", "edition_id", "work_id", "title_zh", "language", "seq", "chapter", "page", "content", (F.col("id") == segment_id).alias("is_target")).orderBy("seq", "id")


@dataclass
class Chapter:
    """What a page of the reader shows: the block, its segments, all blocks, neighbours, and which segments to mark."""

    edition: Row
    target_id: int
    current: Row
    toc: DataFrame
    segments: DataFrame
    primary_id: int | None
    related_ids: list[int]


def read(segments: DataFrame, editions: DataFrame, works: DataFrame, edition_id: int, segment_id: int | None = None, highlight: bool = False, highlights: str = "", query: str = "") -> Chapter:
    """One edition at a segment's block, by default the first chapter. Errors for missing, unindexed and foreign ids."""
    head = editions.where(F.col("id") == edition_id).join(works.select(F.col("id").alias("work_id"), "title_zh", "year"), "work_id").first()
    if head is None:
        raise schema.EditionMissing(f"no edition {edition_id}")
    if head["indexed_at"] is None:
        raise schema.EditionNotIndexed(f"edition {edition_id} is not indexed")
    own = segments.where(F.col("edition_id") == edition_id)
    toc = navigation(reader_blocks(own))
    if segment_id is None:
        found = default_blocks(toc).first()
        segment_id = found["segment_id"] if found else None
    current = toc.where(F.array_contains("segment_ids", segment_id)).first() if segment_id is not None else None
    if current is None:
        raise schema.BlockMissing(f"no block of edition {edition_id} holds segment {segment_id}")
    asked = own.sparkSession.range(1).select(X.highlight_ids(F.lit(highlights)).alias("v")).first()["v"]
    inside = [i for i in asked if i in set(current["segment_ids"])]
    shown = own.where(F.col("id").isin(current["segment_ids"])).orderBy("seq", "id")
    marked = {segment_id, *inside} if highlight or inside else set()
    parts = F.when(F.col("id").isin(list(marked) or [-1]), X.highlight_parts(F.col("content"), query))
    return Chapter(head, segment_id, current, toc.orderBy("block"), shown.withColumn("parts", parts), segment_id if marked else None, [i for i in inside if i != segment_id])
