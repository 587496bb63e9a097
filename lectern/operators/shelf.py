"""The shelf: works with their editions, corpus totals, genres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shelf(works: DataFrame, editions: DataFrame) -> DataFrame:
    """Works with how many editions they have and how many of those are indexed (0 without any), by year."""
    n = editions.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("edition_count"), F.sum(F.when(F.col("indexed_at").isNotNull(), 1).otherwise(0)).alias("indexed_count"))
    return works.join(n, "id", "left").fillna(0, ["edition_count", "indexed_count"]).orderBy(F.asc_nulls_first("year"), "id")


def edition_counts(editions: DataFrame, segments: DataFrame) -> DataFrame:
    """Editions with their number of segments; segments are counted before the join."""
    n = segments.groupBy(F.col("edition_id").alias("id")).agg(F.count("*").alias("segment_count"))
    return editions.join(n, "id", "left").fillna(0, ["segment_count"]).orderBy("language", "id")


def corpus_stats(works: DataFrame, editions: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: works, indexed editions, segments."""
    named = {"works": works, "editions": editions.where(F.col("indexed_at").isNotNull()), "segments": segments}
    counts = [df.agg(F.count("*").alias("n")).withColumn("t", F.lit(k)) for k, df in named.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(*[F.max(F.when(F.col("t") == k, F.col("n"))).alias(k) for k in named])


def genre_set(works: DataFrame) -> DataFrame:
    return works.select(F.explode("genres").alias("genre")).distinct().orderBy("genre")


def with_genre(works: DataFrame, genre: str) -> DataFrame:
    return works.where(F.array_contains("genres", genre))


def shared_files(editions: DataFrame) -> DataFrame:
    """File names that more than one edition refers to."""
    return editions.where(F.col("filename").isNotNull()).groupBy("filename").agg(F.count("*").alias("references")).where(F.col("references") > 1)
