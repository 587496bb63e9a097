"""The corpus model over the driver's tables: works are sources, editions documents, segments their lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import search


@dataclass
class Corpus:
    works: DataFrame
    editions: DataFrame
    segments: DataFrame

    def asked(self, query: str) -> Corpus:
        """The corpus with the segments that can match a query: its tokens are not stored."""
        return Corpus(self.works, self.editions, search.asked_of(self.segments, query))

    def __iter__(self):
        return iter((self.segments, self.editions, self.works))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.substring("source", 4, 9).cast("int")
    works = docs.select("source").distinct().select(
        number.cast("long").alias("id"), F.col("source").alias("title_zh"), F.lit(None).cast("string").alias("title_ja"), F.lit(None).cast("string").alias("title_en"),
        F.when(number % 7 != 0, (1980 + number % 5 * 3).cast("string")).alias("year"),
        F.when(number % 3 == 0, F.array(F.lit("novel"))).when(number % 3 == 1, F.array(F.lit("essay"), F.lit("novel"))).otherwise(F.array(F.lit("story"))).alias("genres"),
    )
    editions = docs.select(
        F.col("doc_id").alias("id"), number.cast("long").alias("work_id"), F.col("lang").alias("language"), F.lit("txt").alias("format"),
        F.concat(F.lit("w"), number, F.lit("_"), "lang", F.lit("_"), F.col("doc_id") % 50, F.lit(".txt")).alias("filename"),
        F.when(F.col("doc_id") % 10 != 0, F.lit("2024-01-01T00:00:00+00:00")).alias("indexed_at"),
    )
    seq = F.col("pos") + 1
    chapter = F.when(seq % 13 == 0, None).when(seq == 1, "Cover").when(seq <= 4, "Part 1").otherwise(F.concat(F.lit("Chapter "), F.floor((seq - 5) / 6) + 1))
    segments = docs.select("doc_id", F.posexplode(X.trimmed_lines(F.col("text"))).alias("pos", "content")).select(
        (F.shiftleft("doc_id", 32) + seq).alias("id"), F.col("doc_id").alias("edition_id"), seq.alias("seq"), chapter.alias("chapter"), F.lit(None).cast("int").alias("page"), "content", X.token_text(F.col("content")).alias("tok")
    )
    return Corpus(works, editions, segments)


#: The same views for DuckDB.
DUCKDB = r"""WITH works AS (
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS title_zh,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) % 7 <> 0 THEN CAST(1980 + CAST(substr(source, 4) AS INTEGER) % 5 * 3 AS VARCHAR) END AS year,
    CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN ['novel'] WHEN 1 THEN ['essay', 'novel'] ELSE ['story'] END AS genres
  FROM documents
), editions AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS work_id, lang AS language, 'txt' AS format,
    'w' || CAST(substr(source, 4) AS INTEGER) || '_' || lang || '_' || (doc_id % 50) || '.txt' AS filename,
    CASE WHEN doc_id % 10 <> 0 THEN '2024-01-01T00:00:00+00:00' END AS indexed_at
  FROM documents
), lists AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2) AS l FROM documents
), cut AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS seq, unnest(l) AS content FROM lists
), segments AS (
  SELECT doc_id * 4294967296 + seq AS id, doc_id AS edition_id, seq, content,
    CASE WHEN seq % 13 = 0 THEN NULL WHEN seq = 1 THEN 'Cover' WHEN seq <= 4 THEN 'Part 1' ELSE 'Chapter ' || ((seq - 5) // 6 + 1) END AS chapter,
    ' ' || array_to_string(regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+'), ' ') || ' ' AS tok
  FROM cut
), hits AS (
  SELECT s.id AS segment_id, s.edition_id, s.content, s.chapter, s.seq, s.tok, e.language, e.format, w.id AS work_id, w.title_zh, w.year, w.genres
  FROM segments s JOIN editions e ON e.id = s.edition_id JOIN works w ON w.id = e.work_id
)
"""
