"""Works and editions: metadata import, ingest, deletion."""

from __future__ import annotations

import os
import posixpath
import re
import shutil
import unicodedata
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as X
from lectern.sources import files as sources
from lectern.store import Store

# The CSV's column names, by ours.
CSV_COLUMNS = {"title_zh": "中文名", "title_ja": "日文名", "title_en": "英文名", "year": "年份", "genres": "体裁", "keywords": "关键词", "status": "状态", "notes": "备注"}


def read_works_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows of a metadata CSV (a byte order mark is passed over) with our names and their order; missing columns are null."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns]).withColumn("row", F.monotonically_increasing_id())
    names = columns or CSV_COLUMNS
    return raw.select("row", *[(F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string")).alias(c) for c, n in names.items()])


def clean_works(rows: DataFrame) -> DataFrame:
    """Trimmed texts, empty ones null, lists parsed; without rows that lack a title, the first row of each title."""
    text = lambda c: F.when(F.length(X.stripped(F.col(c))) > 0, X.stripped(F.col(c)))
    out = rows.select("row", *[text(c).alias(c) for c in ("title_zh", "title_ja", "title_en", "year", "status", "notes")], X.name_list(F.col("genres")).alias("genres"), X.name_list(F.col("keywords")).alias("keywords"))
    first = out.where("title_zh is not null").groupBy("title_zh").agg(F.min_by(F.struct(*out.columns), "row").alias("r"))
    return first.select("r.*")


def new_works(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Cleaned rows whose title is not there yet."""
    return clean_works(rows).join(existing.select("title_zh"), "title_zh", "left_anti")


def numbered(rows: DataFrame, order: str, after: int) -> DataFrame:
    """rows with dense ids in the given order. For metadata, which is small; segments take theirs from their edition."""
    return rows.withColumn("id", F.row_number().over(Window.orderBy(order)).cast("long") + F.lit(after))


def import_works(store: Store, csv: str, columns: dict[str, str] | None = None) -> int:
    """Append the works of a CSV that are new by title; how many."""
    store.init()
    base = store.version()
    existing = store.table("works", base)
    fresh = new_works(existing, read_works_csv(store.spark, csv, columns)).cache()
    try:
        n = fresh.count()
        if n:
            top = existing.agg(F.max("id")).first()[0] or 0
            rows = numbered(fresh, "row", top).select(*schema.WORKS.names)
            store.commit({"works": existing.unionByName(rows)}, base)
        return n
    finally:
        fresh.unpersist()


def bootstrap(store: Store, csv: str) -> int:
    """Create the store and import the CSV if there is one; safe to call at every start."""
    store.init()
    target = store.spark._jvm.org.apache.hadoop.fs.Path(csv)
    return import_works(store, csv) if target.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(target) else 0


def stored_name(work_id: int, language: str, name: str) -> str:
    """wN_language_stem.suffix with an ASCII stem, accents folded; `upload` where nothing of it is left."""
    stem, ext = posixpath.splitext(posixpath.basename(name.replace("\\", "/")))
    stem = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode()
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "", "_".join(stem.split())).strip("._")
    return f"w{work_id}_{language}_{safe or 'upload'}{ext.lower()}"


def add_edition(store: Store, files_dir: str, source: str, work_id: int, language: str, notes: str | None = None, name: str | None = None, encoding: str | None = None) -> int:
    """Copy a file into files_dir, parse it and publish edition and segments together; the new id. On failure the copy goes and no version appears."""
    sources.check_suffix(name or source)
    if language not in schema.LANGUAGES:
        raise ValueError(f"language is one of {schema.LANGUAGES}")
    base = store.init()
    if store.table("works", base).where(F.col("id") == work_id).isEmpty():
        raise schema.WorkMissing(f"no work {work_id}")
    filename = stored_name(work_id, language, name or source)
    target = Path(files_dir) / filename
    shared = target.exists()
    Path(files_dir).mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    try:
        editions = store.table("editions", base)
        edition_id = (editions.agg(F.max("id")).first()[0] or 0) + 1
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        row = store.spark.createDataFrame([(edition_id, work_id, language, sources.suffix(filename)[1:], filename, sources.suffix(filename) == ".pdf", notes, now)], schema.EDITIONS)
        parsed = sources.read_files(store.spark, str(target), encoding=encoding)
        store.commit({"editions": editions.unionByName(row)}, base, {edition_id: indexed(parsed, F.lit(edition_id).cast("long"))})
        return edition_id
    except Exception:
        if not shared:
            target.unlink(missing_ok=True)
        raise


def indexed(parsed: DataFrame, edition_id: Column) -> DataFrame:
    """Parsed segments as rows of the table, with the token column. An id is the edition above 32 bits of the place, which is an int: no two are equal."""
    e = edition_id
    return parsed.select((F.shiftleft(e, 32) + F.col("seq")).alias("id"), e.alias("edition_id"), F.col("seq").cast("int").alias("seq"), "chapter", F.col("page").cast("int").alias("page"), "content", X.token_text(F.col("content")).alias("tok"))


def without_edition(rows: DataFrame, gone: DataFrame, key: str = "edition_id") -> DataFrame:
    """rows of editions that are not in gone (id)."""
    return rows.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(rows.columns)


def safe_file(files_dir: str, filename: str) -> Path:
    """The regular file of that plain name in files_dir; UnsafeFile for anything else."""
    root = Path(files_dir)
    target = root / filename if filename else root
    plain = filename and filename not in (".", "..") and not re.search(r"[/\\]|^[A-Za-z]:", filename)
    if not plain or target.is_symlink() or target.resolve().parent != root.resolve() or (target.exists() and not target.is_file()):
        raise schema.UnsafeFile(f"unsafe file name {filename!r}")
    return target


def delete_edition(store: Store, files_dir: str, work_id: int, edition_id: int) -> dict:
    """Delete an edition with its segments, and its file if no other edition refers to it.

    The file waits in .trash until the new version is published, and goes back if that fails.
    file_status: unrecorded, missing, shared, deleted or cleanup_failed.
    """
    base = store.version()
    works, editions = store.table("works", base), store.table("editions", base)
    if works.where(F.col("id") == work_id).isEmpty():
        raise schema.WorkMissing(f"no work {work_id}")
    edition = editions.where(F.col("id") == edition_id).first()
    if edition is None:
        raise schema.EditionMissing(f"no edition {edition_id}")
    if edition["work_id"] != work_id:
        raise schema.EditionOfOtherWork(f"edition {edition_id} is not of work {work_id}")
    name, status, staged, source, shared = edition["filename"], "unrecorded", None, None, 0
    if name:
        source = safe_file(files_dir, name)
        shared = editions.where((F.col("filename") == name) & (F.col("id") != edition_id)).count()
        status = "missing" if not source.exists() else "shared" if shared else "staged"
    report = {"work_id": work_id, "edition_id": edition_id, "language": edition["language"], "format": edition["format"], "filename": name, "shared_references": shared, "segment_count": store.edition(edition_id, base).count()}
    if status == "staged":
        trash = Path(files_dir) / ".trash"
        trash.mkdir(exist_ok=True)
        if trash.is_symlink():
            raise schema.UnsafeFile(".trash is a link")
        staged = trash / f"edition-{edition_id}-{uuid.uuid4().hex}"
        os.replace(source, staged)
    try:
        gone = editions.where(F.col("id") == edition_id).select("id")
        store.commit({"editions": without_edition(editions, gone, "id")}, base, {edition_id: None})
    except Exception:
        if staged is not None:
            if source.exists():
                raise schema.RestoreFailed(f"the file is in {staged}") from None
            os.replace(staged, source)
        raise
    if staged is not None:
        try:
            staged.unlink()
            status = "deleted"
        except OSError as e:
            return report | {"file_status": "cleanup_failed", "staged_path": str(staged), "cleanup_error": str(e)}
    return report | {"file_status": status}
