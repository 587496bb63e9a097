"""The column functions by name, for SQL: `SELECT * FROM segments WHERE contains(token_text(content), token_text('羊男'))`.

They are SQL functions, which the optimiser expands into the same built-in expressions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern.functions import text as X


def definitions() -> dict[str, str]:
    """Signature and body of each function, by name."""
    source, target = X.fold_table()
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LABELS.items())
    return {
        "cjk_space": f"(s STRING) RETURNS STRING RETURN regexp_replace(s, r'([{X.CJK_RANGES}])', ' $1 ')",
        "token_text": f"(s STRING) RETURNS STRING RETURN concat(' ', array_join(regexp_extract_all(translate(lower(cjk_space(coalesce(s, ''))), '{source}', '{target}'), r'[\\p{{L}}\\p{{N}}\\p{{Co}}]+', 0), ' '), ' ')",
        "locator": "(page INT, chapter STRING, seq INT) RETURNS STRING RETURN coalesce(CASE WHEN page <> 0 THEN concat('p.', page) END, CASE WHEN chapter <> '' THEN chapter END, concat('#', seq))",
        "chapter_key": "(edition_id BIGINT, chapter STRING) RETURNS STRING RETURN substring(sha2(concat(CAST(edition_id AS STRING), char(0), coalesce(chapter, '')), 256), 1, 16)",
        "language_label": f"(lang STRING) RETURNS STRING RETURN CASE lang {labels} ELSE lang END",
        "readable": f"(s STRING) RETURNS BOOLEAN RETURN regexp_replace(coalesce(s, ''), r'(?U)^\\s+|\\s+$', '') RLIKE r'[\\p{{L}}\\p{{N}}]' AND NOT regexp_replace(coalesce(s, ''), r'(?U)^\\s+|\\s+$', '') RLIKE r'{X.WEB_ADDRESS}'",
    }


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, rest in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
