"""Postings: which segments hold a token, in folders by the token's hash, so that a search reads the files of its own tokens.

A token that most segments hold has as many rows as those segments; they are dealt to SPREAD tasks when they are written,
and read as rows, never as one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X

BUCKETS, SPREAD = 64, 8


def postings(segments: DataFrame) -> DataFrame:
    """bucket, token and segment_id: each token of a segment once. segments: id and tok."""
    each = segments.select(F.col("id").alias("segment_id"), F.explode(F.array_distinct(F.split(F.trim("tok"), " "))).alias("token")).where("token <> ''")
    return each.select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket"), "token", "segment_id")


def write_postings(segments: DataFrame, path: str) -> None:
    rows = postings(segments).repartition("bucket", F.pmod(F.xxhash64("segment_id"), F.lit(SPREAD)))
    rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)


def query_tokens(spark: SparkSession, query: str) -> list[tuple[int, str]]:
    """(bucket, token) of a query's phrases, as the segments' own tokens are made."""
    phrases = X.phrase_texts(query)
    if not phrases:
        return []
    words = F.array_distinct(F.flatten(F.array(*[X.tokens(F.lit(p)) for p in phrases])))
    rows = spark.range(1).select(F.explode(words).alias("token")).select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"), "token").collect()
    return [tuple(r) for r in rows]


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """segment_id of the segments that hold every token of the query; only their buckets are read."""
    wanted = query_tokens(spark, query)
    rows = spark.read.schema("token string, segment_id long, bucket int").parquet(path)
    rows = rows.where(F.col("bucket").isin(sorted({b for b, _ in wanted}))).where(F.col("token").isin([t for _, t in wanted]))
    return rows.groupBy("segment_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("segment_id")


def narrowed(segments: DataFrame, path: str, query: str) -> DataFrame:
    """The segments that can match, for search functions to verify the phrases on."""
    return segments.join(candidates(segments.sparkSession, path, query).withColumnRenamed("segment_id", "id"), "id", "left_semi").select(segments.columns)
