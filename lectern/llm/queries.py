"""The opN_ queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, compaction, ctw, divergence, flac, packing, simhash, token_output, toxicity, warc
from lectern.llm.common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.matrix_digest(token_output.packed_matrices(table(spark, sf_dir, "documents")))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digest(flac.store_flac(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digest(table(spark, sf_dir, "documents"))


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(table(spark, sf_dir, "documents"))


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_digest(warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_token_output, op2_flac, op3_toxicity, op4_simhash, op5_bpe, op6_compaction, op7_divergence, op8_warc, op9_packing, op10_ctw)
    return {f.__name__: f for f in all_of}


def _half(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * ({p}) / (({p}) + ({q}))) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * ({q}) / (({p}) + ({q}))) ELSE 0 END)"


def _op7_sql() -> str:
    """The quality rules for DuckDB, with one row for each doc_id: references, distances and verdict as in divergence."""
    limits = divergence.Limits()
    gap, rests, rest = "[\\x20\\x09-\\x0D]+", [], "t"
    for pattern in divergence.CLASS_PATTERNS:
        less = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')".replace("\\\\", "\\")
        rests.append(f"length({rest}) - length({less})")
        rest = less
    classes = ", ".join([*rests, f"length({rest})"])
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS words, [{classes}] AS c FROM d),
u AS (SELECT doc_id, lang, unnest(words) AS word FROM w),
totals AS (SELECT lang, sum(len(words)) AS total FROM w WHERE lang IS NOT NULL GROUP BY lang),
largest AS (SELECT lang, total FROM totals WHERE total > 0 ORDER BY total DESC, lang LIMIT {math.ceil(1 / divergence.LANGUAGE_SHARE)}),
langs AS (SELECT lang, total FROM largest WHERE total >= least({divergence.MIN_WORDS}, {divergence.LANGUAGE_SHARE} * (SELECT sum(total) FROM largest))),
refw AS (SELECT lang, word, count(*) / any_value(total) AS q FROM u JOIN langs USING (lang) GROUP BY lang, word HAVING count(*) >= {divergence.MIN_SHARE} * any_value(total)),
sumq AS (SELECT lang, coalesce(sum(q), 0) AS s FROM refw GROUP BY lang),
cls AS (SELECT doc_id, lang, len(t) AS n, unnest(generate_series(1, 7)) AS i, unnest(c) AS k FROM w),
refc AS (SELECT lang, i, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS q FROM cls JOIN langs USING (lang) GROUP BY lang, i),
cd AS (SELECT doc_id, min(x) AS dc FROM (
  SELECT doc_id, r.lang, sqrt(greatest(sum({_half("(k / n)", "r.q")}) / 2, 0)) AS x FROM cls JOIN refc r USING (i) WHERE n >= {limits.min_chars} AND (cls.lang IS NULL OR cls.lang IN (SELECT lang FROM langs)) GROUP BY doc_id, r.lang) GROUP BY doc_id),
long AS (SELECT doc_id, len(words) AS n FROM w WHERE len(words) >= {limits.min_words} AND (lang IS NULL OR lang IN (SELECT lang FROM langs))),
dw AS (SELECT doc_id, word, count(*) AS k FROM u SEMI JOIN long USING (doc_id) SEMI JOIN refw USING (word) GROUP BY ALL),
parts AS (SELECT doc_id, r.lang, sum({_half("(k / n)", "r.q")}) AS s, sum(k / n) AS p, sum(r.q) AS q FROM dw JOIN long USING (doc_id) JOIN refw r USING (word) GROUP BY doc_id, r.lang),
wd AS (SELECT doc_id, min(sqrt(greatest((coalesce(s, 0) + sq - coalesce(q, 0) + {_half("greatest(1 - coalesce(p, 0), 0)", "greatest(1 - sq, 0)")}) / 2, 0))) AS dw
  FROM (SELECT doc_id, lang, sumq.s AS sq FROM long CROSS JOIN sumq) g LEFT JOIN parts USING (doc_id, lang) GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS key FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) > 8)),
twice AS (SELECT doc_id, key FROM win GROUP BY doc_id, key HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, key) CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(t) - c[2] AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, dc, dw FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(dc <= {limits.char_distance}, true) AND coalesce(dw <= {limits.word_distance}, true) AS kept FROM m
""".replace("\\\\x", "\\x")


def oracle_sql() -> dict[str, str]:
    """Only the quality rules are within SQL's reach: the other operators' hashes, codecs, vocabularies and models are not."""
    return {"op7_divergence": _op7_sql()}
