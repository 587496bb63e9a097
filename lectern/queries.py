"""Registered queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import catalog, reader, repair, search, shelf
from lectern.plans.views import DUCKDB, corpus
from lectern.sources.html import html_blocks
from lectern.sources.txt import CHAPTER_LINE, text_segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HIT = ["segment_id", "edition_id", "work_id", "language", "year", "seq", "chapter", "content"]
HIT_SQL = "segment_id, edition_id, work_id, language, year, seq, chapter, content"
ORDER_SQL = "year NULLS FIRST, language, seq, edition_id, segment_id"


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (DUCKDB if views else "") + sql
        return f

    return add


def both(*words: str) -> str:
    return " AND ".join(f"contains(tok, ' {w} ')" for w in words)


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('thing')} ORDER BY {ORDER_SQL} LIMIT 100")
def search_latin(spark, sf_dir):
    return search.search(*corpus(spark, sf_dir).asked("Thing"), "Thing").select(*HIT)


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('the', 'tion')} ORDER BY {ORDER_SQL} LIMIT 100")
def search_and(spark, sf_dir):
    return search.search(*corpus(spark, sf_dir).asked("the tion"), "the tion").select(*HIT)


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('and of')} ORDER BY {ORDER_SQL} LIMIT 50")
def search_phrase(spark, sf_dir):
    return search.search(*corpus(spark, sf_dir).asked('"and of"'), '"and of"', limit=50).select(*HIT)


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('der')} AND language = 'de' ORDER BY {ORDER_SQL} LIMIT 100")
def search_lang(spark, sf_dir):
    return search.search(*corpus(spark, sf_dir).asked("der"), "der", language="de").select(*HIT)


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('the')} AND list_contains(genres, 'essay') ORDER BY {ORDER_SQL} LIMIT 100")
def search_genre(spark, sf_dir):
    return search.search(*corpus(spark, sf_dir).asked("the"), "the", genre="essay").select(*HIT)


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('pere')} OR {both('fur')} OR {both('e')} ORDER BY {ORDER_SQL} LIMIT 100")
def search_accent_fold(spark, sf_dir):
    c = corpus(spark, sf_dir)
    found = [search.hits(*c.asked(q), q) for q in ("père", "FÜR", "é")]
    return found[0].unionByName(found[1]).unionByName(found[2]).dropDuplicates(["segment_id"]).orderBy(*search.reading_order()).limit(100).select(*HIT)


GROUPED = f"grouped AS (SELECT *, count(*) OVER (PARTITION BY work_id) AS total_hits, row_number() OVER (PARTITION BY work_id ORDER BY language, seq, edition_id, segment_id) AS hit_rank FROM hits WHERE {both('thing')})"


@query(f", {GROUPED} SELECT {HIT_SQL}, total_hits FROM grouped WHERE hit_rank <= 30")
def search_grouped(spark, sf_dir):
    return search.search_grouped(*corpus(spark, sf_dir).asked("thing"), "thing").select(*HIT, "total_hits")


@query(f"SELECT {HIT_SQL} FROM hits WHERE {both('thing')} AND work_id = 3")
def search_work(spark, sf_dir):
    return search.search_work(*corpus(spark, sf_dir).asked("thing"), "thing", 3).select(*HIT)


@query(f", {GROUPED} SELECT work_id, title_zh, year, max(total_hits) AS total_hits, count(*) AS displayed_hits, count(*) < max(total_hits) AS is_truncated FROM grouped WHERE hit_rank <= 30 GROUP BY ALL")
def search_work_groups(spark, sf_dir):
    return search.group_works(search.search_grouped(*corpus(spark, sf_dir).asked("thing"), "thing"))


@query(f""", {GROUPED}, g AS (SELECT edition_id, language, nullif(chapter, '') AS chapter, list(segment_id ORDER BY seq, segment_id) AS ids FROM grouped WHERE hit_rank <= 30 GROUP BY ALL)
SELECT edition_id, language, chapter, left(sha256(CAST(edition_id AS VARCHAR) || chr(0) || coalesce(chapter, '')), 16) AS chapter_key, ids[1] AS primary_segment_id,
  array_to_string(ids[2:], ',') AS additional, CAST(len(ids) AS INTEGER) AS chapter_hit_count, array_to_string(ids[1:200], ',') AS highlights_param, len(ids) > 1 AS is_multi_hit FROM g""")
def chapter_groups(spark, sf_dir):
    g = search.group_chapters(search.search_grouped(*corpus(spark, sf_dir).asked("thing"), "thing"))
    text = F.array_join(F.transform("additional_segment_ids", lambda i: i.cast("string")), ",")
    return g.select("edition_id", "language", "chapter", "chapter_key", "primary_segment_id", text.alias("additional"), "chapter_hit_count", "highlights_param", "is_multi_hit")


@query("SELECT edition_id, chapter, left(sha256(CAST(edition_id AS VARCHAR) || chr(0) || coalesce(chapter, '')), 16) AS chapter_key FROM segments GROUP BY edition_id, chapter")
def chapter_key(spark, sf_dir):
    s = corpus(spark, sf_dir).segments.select("edition_id", "chapter").distinct()
    return s.withColumn("chapter_key", X.chapter_key(F.col("edition_id"), F.col("chapter")))


@query(r""", m AS (SELECT id, content, regexp_extract_all(content, '(?i)\bthing\b') AS h, regexp_split_to_array(content, '(?i)\bthing\b') AS g FROM segments WHERE contains(tok, ' thing ')),
u AS (SELECT id, content, g, CAST(unnest(generate_series(1, least(len(h), 5))) AS INTEGER) AS n, unnest(h[1:5]) AS match FROM m WHERE len(h) > 0),
p AS (SELECT *, CAST(list_sum(list_transform(g[1:n], lambda x: length(x))) + 5 * (n - 1) AS INTEGER) AS before FROM u)
SELECT id AS segment_id, n, substring(content, greatest(before - 60, 0) + 1, least(before, 60)) AS "left", match, substring(content, before + length(match) + 1, 60) AS "right" FROM p""")
def kwic(spark, sf_dir):
    s = corpus(spark, sf_dir).asked("thing").segments.where(X.matches(F.col("tok"), "thing"))
    rows = s.select(F.col("id").alias("segment_id"), F.posexplode(X.kwic(F.col("content"), "thing")).alias("i", "c"))
    return rows.select("segment_id", (F.col("i") + 1).alias("n"), "c.left", "c.match", "c.right")


@query(r"""SELECT id AS segment_id, length(regexp_replace(content, '(?i)\bthing\b', '', 'g')) AS plain_chars, CAST(len(regexp_extract_all(content, '(?i)\bthing\b')) AS INTEGER) AS marks, content AS text FROM segments WHERE contains(tok, ' thing ')""")
def highlight_parts(spark, sf_dir):
    s = corpus(spark, sf_dir).asked("thing").segments.where(X.matches(F.col("tok"), "thing")).select("id", X.highlight_parts(F.col("content"), "thing").alias("p"))
    plain = F.aggregate(F.filter("p", lambda x: ~x["is_match"]), F.lit(0), lambda a, x: a + F.length(x["text"])).cast("long")
    return s.select(F.col("id").alias("segment_id"), plain.alias("plain_chars"), F.size(F.filter("p", lambda x: x["is_match"])).alias("marks"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


@query("SELECT w.id, w.title_zh, w.year, count(e.id) AS edition_count, CAST(sum(CASE WHEN e.indexed_at IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS indexed_count FROM works w LEFT JOIN editions e ON e.work_id = w.id GROUP BY ALL")
def shelf_works(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shelf.shelf(c.works, c.editions).select("id", "title_zh", "year", "edition_count", "indexed_count")


@query("SELECT (SELECT count(*) FROM works) AS works, (SELECT count(*) FROM editions WHERE indexed_at IS NOT NULL) AS editions, (SELECT count(*) FROM segments) AS segments")
def corpus_stats(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shelf.corpus_stats(c.works, c.editions, c.segments)


@query("SELECT e.id, e.language, e.filename, count(s.id) AS segment_count FROM editions e LEFT JOIN segments s ON s.edition_id = e.id GROUP BY ALL")
def edition_counts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shelf.edition_counts(c.editions, c.segments).select("id", "language", "filename", "segment_count")


@query("SELECT DISTINCT unnest(genres) AS genre FROM works")
def genre_set(spark, sf_dir):
    return shelf.genre_set(corpus(spark, sf_dir).works)


@query("SELECT id, title_zh, year FROM works WHERE list_contains(genres, 'novel')")
def genre_filter(spark, sf_dir):
    return shelf.with_genre(corpus(spark, sf_dir).works, "novel").select("id", "title_zh", "year")


@query("SELECT filename, count(*) AS \"references\" FROM editions GROUP BY filename HAVING count(*) > 1")
def shared_files(spark, sf_dir):
    return shelf.shared_files(corpus(spark, sf_dir).editions)


@query("SELECT s.id, s.edition_id, s.seq, s.chapter, s.content, s.id = 30064771078 AS is_target FROM segments s WHERE s.edition_id = 7 AND s.seq BETWEEN 1 AND 11 AND EXISTS (SELECT 1 FROM segments t WHERE t.id = 30064771078)")
def segment_context(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return reader.segment_context(c.segments, c.editions, c.works, 30064771078).select("id", "edition_id", "seq", "chapter", "content", "is_target")


READABLE = r"(regexp_matches(content, '[\p{L}\p{N}]') AND NOT regexp_full_match(trim(content), '(?i)(?:https?://)?(?:www\.)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?:[/#?]\S*)?'))"
BLOCKS = f""", r AS (SELECT * FROM segments WHERE {READABLE}),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR chapter IS DISTINCT FROM lag(chapter) OVER w THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY edition_id ORDER BY seq, id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY edition_id ORDER BY seq, id) - 1 AS block FROM f),
b AS (SELECT edition_id, CAST(block AS INTEGER) AS block, any_value(chapter) AS chapter, min(id) AS first_segment_id, min(seq) AS first_seq, max(seq) AS last_seq, list(id ORDER BY seq) AS ids,
  CASE WHEN any_value(chapter) LIKE 'Chapter%' THEN 'chapter' WHEN any_value(chapter) LIKE 'Part%' THEN 'part' WHEN any_value(chapter) = 'Cover' THEN 'frontmatter' ELSE 'other' END AS k FROM n GROUP BY edition_id, block),
blocks AS (SELECT *, CASE WHEN k = 'other' AND block < min(CASE WHEN k = 'chapter' THEN block END) OVER e THEN 'frontmatter' WHEN k = 'other' AND block > max(CASE WHEN k = 'chapter' THEN block END) OVER e THEN 'backmatter' ELSE k END AS kind,
  coalesce(nullif(chapter, ''), '未标注章节') AS title FROM b WINDOW e AS (PARTITION BY edition_id))
"""


@query(BLOCKS + "SELECT edition_id, block, title, chapter, kind, first_segment_id, first_seq, last_seq, array_to_string(ids, ',') AS segment_ids FROM blocks")
def reader_blocks(spark, sf_dir):
    b = reader.reader_blocks(corpus(spark, sf_dir).segments)
    return b.withColumn("segment_ids", F.array_join(F.transform("segment_ids", lambda i: i.cast("string")), ","))


@query(BLOCKS + "SELECT edition_id, arg_min(first_segment_id, CASE WHEN kind = 'chapter' THEN 0 ELSE 1000000 END + block) AS segment_id FROM blocks GROUP BY edition_id")
def reader_default_target(spark, sf_dir):
    return reader.default_blocks(reader.reader_blocks(corpus(spark, sf_dir).segments))


@query(BLOCKS + "SELECT edition_id, block, title, lag(first_segment_id) OVER w AS previous_id, lead(first_segment_id) OVER w AS next_id FROM blocks WINDOW w AS (PARTITION BY edition_id ORDER BY block)")
def reader_nav(spark, sf_dir):
    return reader.navigation(reader.reader_blocks(corpus(spark, sf_dir).segments)).select("edition_id", "block", "title", "previous_id", "next_id")


@query(BLOCKS + "SELECT kind, count(*) AS blocks FROM blocks GROUP BY kind")
def block_kinds(spark, sf_dir):
    return reader.reader_blocks(corpus(spark, sf_dir).segments).groupBy("kind").agg(F.count("*").alias("blocks"))


@query(f"SELECT edition_id, count(*) AS readable FROM segments WHERE {READABLE} GROUP BY edition_id")
def readable_segments(spark, sf_dir):
    return corpus(spark, sf_dir).segments.where(X.readable(F.col("content"))).groupBy("edition_id").agg(F.count("*").alias("readable"))


TXT = r""", parts AS (SELECT doc_id, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN regexp_split_to_array(text, '\n\s*\n') ELSE regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]') END,
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 2) AS l FROM documents),
t AS (SELECT doc_id, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS seq, unnest(l) AS content FROM parts)
"""


@query(TXT + "SELECT doc_id, seq, content FROM t")
def txt_segments(spark, sf_dir):
    return text_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").select("doc_id", "seq", "content")


CHAPTERED = "SELECT doc_id, 'Chapter ' || (doc_id % 9) || chr(10) || text || chr(10) || '12' || chr(10) || lang || ' end' AS text FROM documents"


@query(TXT.replace("FROM documents)", f"FROM ({CHAPTERED}))") + f""", c AS (SELECT *, CASE WHEN regexp_matches(trim(string_split(content, chr(10))[1]), '{CHAPTER_LINE.replace(chr(92) + chr(92), chr(92))}') AND length(trim(string_split(content, chr(10))[1])) < 40 THEN trim(string_split(content, chr(10))[1]) END AS mark FROM t)
SELECT doc_id, seq, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS chapter, length(content) AS n_chars FROM c""")
def txt_chapters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("Chapter "), F.col("doc_id") % 9, F.lit("\n"), "text", F.lit("\n12\n"), "lang", F.lit(" end"))
    return text_segments(docs.select("doc_id", text.alias("text")), "doc_id").select("doc_id", "seq", "chapter", F.length("content").cast("long").alias("n_chars"))


SAMPLES = [(1, "羊男在图书馆"), (2, "羊の男"), (3, "羊 男"), (4, "カフカ・海辺"), (5, "ab羊cd"), (6, "羊男井户"), (7, "羊男 and 井户"), (8, "Café"), (9, "water only"), (10, "well-known foo_bar")]
SAMPLE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SAMPLES) + ") v(id, content) UNION ALL SELECT doc_id + 1000, '羊男' || text || '女ab羊' FROM documents"
CJK_SQL = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]"
TOK_SQL = rf"' ' || array_to_string(regexp_extract_all(lower(strip_accents(regexp_replace(content, '({CJK_SQL})', ' \1 ', 'g'))), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples and all documents, each between CJK characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select((F.col("doc_id") + 1000).alias("id"), F.concat(F.lit("羊男"), "text", F.lit("女ab羊")).alias("content"))
    return spark.createDataFrame(SAMPLES, "id long, content string").unionByName(texts).withColumn("tok", X.token_text(F.col("content")))


@query(rf"SELECT id, regexp_replace(content, '({CJK_SQL})', ' \1 ', 'g') AS spaced, {TOK_SQL} AS tok FROM ({SAMPLE_SQL}) t(id, content)", views=False)
def cjk_space(spark, sf_dir):
    return _samples(spark, sf_dir).select("id", X.cjk_space(F.col("content")).alias("spaced"), "tok")


@query(f"SELECT id, content FROM (SELECT *, {TOK_SQL} AS tok FROM ({SAMPLE_SQL}) t(id, content)) WHERE contains(tok, ' 羊 男 ')", views=False)
def cjk_search(spark, sf_dir):
    return _samples(spark, sf_dir).where(X.matches(F.col("tok"), "羊　男")).select("id", "content")


@query(f"SELECT id, content FROM (SELECT *, {TOK_SQL} AS tok FROM ({SAMPLE_SQL}) t(id, content)) WHERE contains(tok, ' ab 羊 ')", views=False)
def mixed_script(spark, sf_dir):
    return _samples(spark, sf_dir).where(X.matches(F.col("tok"), "ab羊")).select("id", "content")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a|b' || doc_id WHEN 1 THEN doc_id || '|y|z' WHEN 3 THEN 'one|two|three' || doc_id WHEN 4 THEN '[broken' || doc_id ELSE '' END AS names FROM documents""", views=False)
def list_normalize(spark, sf_dir):
    """Lists as JSON, between separators of several scripts, empty, broken and null."""
    docs, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id").cast("string")
    raws = [F.concat(F.lit('["a", "b'), i, F.lit('"]')), F.concat(i, F.lit("、y，z")), F.lit(""), F.concat(F.lit("one; two/three"), i), F.concat(F.lit("[broken"), i)]
    raw = F.lit(None).cast("string")
    for n, r in enumerate(raws):
        raw = F.when(F.col("doc_id") % 6 == n, r).otherwise(raw)
    return docs.select("doc_id", F.array_join(X.name_list(raw), "|").alias("names"))


IMPORT_SQL = "first AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source)"


@query(f"WITH {IMPORT_SQL} SELECT source AS title_zh, lang AS title_en FROM first JOIN documents USING (doc_id, source) WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 5)", views=False)
def import_dedupe(spark, sf_dir):
    """The works of the first documents are there; the others' come in, each by its first row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("row"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("title_zh"), none.alias("title_ja"), F.col("lang").alias("title_en"), none.alias("year"), none.alias("genres"), none.alias("keywords"), none.alias("status"), none.alias("notes"))
    existing = docs.where("doc_id < 5").select(F.col("source").alias("title_zh"))
    return catalog.new_works(existing, rows).select("title_zh", "title_en")


@query("SELECT count(DISTINCT source) FILTER (WHERE doc_id < 5) AS first_import, CAST(0 AS BIGINT) AS second_import, count(DISTINCT source) - count(DISTINCT source) FILTER (WHERE doc_id < 5) AS after_append FROM documents", views=False)
def bootstrap_delta(spark, sf_dir):
    """How many works an import adds: at first, again, and after rows have been added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("row"), F.col("source").alias("title_zh"), *[none.alias(c) for c in ("title_ja", "title_en", "year", "genres", "keywords", "status", "notes")])
    few = rows.where("row < 5")
    runs = {"first_import": (few.where("false"), few), "second_import": (few, few), "after_append": (few, rows)}
    counts = [catalog.new_works(have.select("title_zh"), new).agg(F.count("*").alias("n")).withColumn("run", F.lit(k)) for k, (have, new) in runs.items()]
    whole = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return whole.agg(*[F.max(F.when(F.col("run") == k, F.col("n"))).alias(k) for k in runs])


@query("SELECT edition_id, count(*) AS segments FROM segments WHERE edition_id % 10 <> 0 GROUP BY edition_id")
def delete_edition_segments(spark, sf_dir):
    """What is left once the editions that were never indexed are gone."""
    c = corpus(spark, sf_dir)
    return catalog.without_edition(c.segments, c.editions.where("indexed_at is null").select("id")).groupBy("edition_id").agg(F.count("*").alias("segments"))


ALTERED = "CASE WHEN seq % 4 = 0 THEN 'Chapter ' || (seq // 4) ELSE chapter END"


def _altered(c):
    return c.segments.withColumn("chapter", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Chapter "), F.floor(F.col("seq") / 4))).otherwise(F.col("chapter")))


@query(f"SELECT edition_id, seq, id AS segment_id, chapter AS old_chapter, {ALTERED} AS new_chapter FROM segments WHERE chapter IS DISTINCT FROM {ALTERED}")
def repair_diff(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return repair.chapter_changes(c.segments, _altered(c))


@query(f"SELECT chapter AS old_chapter, {ALTERED} AS new_chapter, count(*) AS n FROM segments WHERE chapter IS DISTINCT FROM {ALTERED} GROUP BY ALL")
def repair_mappings(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return repair.mapping_counts(repair.chapter_changes(c.segments, _altered(c)))


@query("SELECT edition_id, count(*) AS differences FROM segments WHERE edition_id % 7 = 0 AND seq % 5 = 0 GROUP BY edition_id")
def repair_misaligned(spark, sf_dir):
    c = corpus(spark, sf_dir)
    other = c.segments.withColumn("content", F.when((F.col("edition_id") % 7 == 0) & (F.col("seq") % 5 == 0), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return repair.misaligned(c.segments, other)


@query()
def html_block_texts(spark, sf_dir):
    return html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("""SELECT doc_id, CASE WHEN doc_id = 0 THEN '1,4' WHEN doc_id = 4 THEN '4,5' WHEN doc_id = 3 THEN '3,4' ELSE doc_id || ',' || (doc_id + 1) || ',4' END AS ids FROM documents""", views=False)
def highlight_ids(spark, sf_dir):
    """Lists of ids with repeats, zeros, signs and digits of other scripts."""
    docs, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    raw = F.concat(i, F.lit(","), i, F.lit(",bad,-2,３,,0,"), i + 1, F.lit(", 4"))
    return docs.select("doc_id", F.array_join(F.transform(X.highlight_ids(raw), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT lang, CASE lang WHEN 'zh' THEN '中' WHEN 'ja' THEN '日' WHEN 'en' THEN '英' ELSE lang END AS label, count(*) AS n FROM documents GROUP BY lang", views=False)
def lang_label(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("n")).select("lang", X.language_label(F.col("lang")).alias("label"), "n")


@query("SELECT id, coalesce(nullif(chapter, ''), '#' || seq) AS place FROM segments")
def locator(spark, sf_dir):
    return corpus(spark, sf_dir).segments.select("id", X.locator(F.col("page"), F.col("chapter"), F.col("seq")).alias("place"))


from lectern import book_queries  # noqa: E402, F401  registers its queries, with what is above
