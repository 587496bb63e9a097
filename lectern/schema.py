"""Tables of the corpus and the errors its operations raise."""

from __future__ import annotations

from pyspark.sql import types as T

WORKS = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("title_zh", "title_ja", "title_en", "year")], T.StructField("genres", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("status", T.StringType()), T.StructField("notes", T.StringType())])
EDITIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("work_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("language", "format", "filename")], T.StructField("has_pages", T.BooleanType()), T.StructField("notes", T.StringType()), T.StructField("indexed_at", T.StringType())])
SEGMENTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("edition_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("chapter", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("tok", T.StringType())])
TABLES = {"works": WORKS, "editions": EDITIONS, "segments": SEGMENTS}
LANGUAGES = ("zh", "ja", "en")


class CorpusError(RuntimeError):
    """Any failure of an operation on the corpus."""


class DeleteError(CorpusError):
    pass


class WorkMissing(DeleteError):
    pass


class EditionMissing(DeleteError):
    pass


class EditionOfOtherWork(DeleteError):
    pass


class UnsafeFile(DeleteError):
    pass


class RestoreFailed(DeleteError):
    pass


class EditionNotIndexed(CorpusError):
    pass


class BlockMissing(CorpusError):
    pass


class SegmentMissing(CorpusError):
    pass


class ReadOnly(CorpusError):
    pass


class RepairRefused(CorpusError):
    """Carries the report that says why."""

    def __init__(self, report):
        super().__init__("; ".join(report.issues[:3]) or "refused")
        self.report = report
