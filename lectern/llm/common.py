"""What the operators of this folder share: tables, the shared scratch folder, Arrow text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this folder: \x20 and \x09-\x0D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; an own one only where it is unset and all runs in one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(where)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: later plans start from replicated files, not from lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % folds


def arrow_texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null is empty, broken UTF-8 becomes replacement characters."""
    try:
        return ["" if x is None else x for x in column.to_pylist()]
    except UnicodeDecodeError:
        return ["" if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def arrow_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column as they are; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about limit bytes of text (one row at least): bounds a worker's memory."""
    if batch.num_rows == 0:
        return
    col = batch.column(text) if isinstance(text, str) else text
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)
