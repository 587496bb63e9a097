"""Token ids as packed binary matrices (operator 1): best-fit-decreasing rows, cumulative segment lengths, position resets.

A row of a matrix is one training sequence. Overlong documents are split without loss before packing, so a sequence never
holds more than its capacity and every id of every document is in exactly one sequence. write_matrices() packs in the task
that tokenises and writes there: no shuffle but for the few sequences that were left with room (see packing).
read_matrices() reads the files back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import scratch_path
from lectern.llm.packing import GROUP_TOKENS, ROOM, Run, again_id, dealt, packing_runs, public_encoder, texts_of

MATRIX_DDL = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
MATRIX = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])
OPEN, OPEN_DDL = MATRIX.append(pa.field("open", pa.bool_())), MATRIX_DDL + ", open boolean"
KINDS = {2: "<u2", 4: "<u4"}


def matrix_rows(run: Run, capacity: int, base: int, pad: bytes) -> dict[str, list]:
    """The columns of OPEN for a run's sequences, numbered from base."""
    bins, offsets, used = run.pack(capacity)
    order = np.lexsort((offsets, bins))
    ends = np.cumsum(np.bincount(bins))
    out: dict[str, list] = {c: [] for c in OPEN.names}
    for b, members in enumerate(np.split(order, ends[:-1])):
        at = members.tolist()
        bounds = [0, *np.cumsum([run.length[i] for i in at]).tolist()]
        ids = b"".join([run.ids[i] for i in at])
        row = (base + b, bounds[-1], ids + pad[len(ids) :], bounds, bounds[:-1], [run.doc_id[i] for i in at], [run.piece[i] for i in at], [run.start[i] for i in at], bool(capacity - used[b] >= ROOM * capacity))
        for c, x in zip(OPEN.names, row, strict=True):
            out[c].append(x)
    return out


def _batches(rows: dict[str, list], schema: pa.Schema, most: int = 2048) -> Iterable[pa.RecordBatch]:
    for i in range(0, len(rows["sequence_id"]), most):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][i : i + most], f.type) for f in schema], schema=schema)


def write_matrices(docs: DataFrame, path: str, capacity: int = 1024, end_id: int | None = 2, pad_id: int = 0, width: int = 2, encoder: Callable = public_encoder, group_tokens: int = GROUP_TOKENS) -> None:
    """Pack docs and write them under path, a folder that is not there yet: path/first, and path/again for the sequences that were packed a second time.

    A row per sequence. input_ids: capacity ids of width bytes, little endian, padded with pad_id after n_tokens, so
    that every row of a file has the same size. cu_seqlens: 0 and the end of each segment. position_resets: the places in the
    row where position ids begin again at 0. doc_ids, pieces, starts: what each segment is, so that documents can be rebuilt.
    Null or empty texts hold their end id; an id that does not fit width raises OverflowError; an empty
    table gives no rows; repeated rows are written as often as they come.
    """
    pad = np.full(capacity, pad_id, KINDS[width]).tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for run in packing_runs(batches, encoder(), capacity, end_id, KINDS[width], group_tokens):
            rows = matrix_rows(run, capacity, base, pad)
            base += len(rows["sequence_id"])
            yield from _batches(rows, OPEN)

    def second(key: tuple, t: pa.Table) -> pa.Table:
        run = Run()
        for row in t.sort_by("sequence_id").to_pylist():
            for a, b, doc_id, piece, start in zip(row["cu_seqlens"], row["cu_seqlens"][1:], row["doc_ids"], row["pieces"], row["starts"], strict=False):
                for to, x in ((run.doc_id, doc_id), (run.piece, piece), (run.start, start), (run.length, b - a), (run.ids, row["input_ids"][width * a : width * b])):
                    to.append(x)
        return pa.Table.from_batches(_batches(matrix_rows(run, capacity, again_id(key[0].as_py()), pad), MATRIX), MATRIX)

    spark = docs.sparkSession
    texts_of(docs).mapInArrow(first, OPEN_DDL).write.parquet(f"{path}/first")
    rest = spark.read.schema(OPEN_DDL).parquet(f"{path}/first").where("open")
    dealt(rest, "n_tokens").groupBy("grp").applyInArrow(second, MATRIX_DDL).write.parquet(f"{path}/again")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The sequences that write_matrices() has written."""
    return spark.read.schema(OPEN_DDL).parquet(f"{path}/first").where("not open").drop("open").unionByName(spark.read.schema(MATRIX_DDL).parquet(f"{path}/again"))


def packed_matrices(docs: DataFrame, **options) -> DataFrame:
    """docs written to the scratch folder and read back."""
    path = scratch_path(docs.sparkSession, "matrices")
    write_matrices(docs, path, **options)
    return read_matrices(docs.sparkSession, path)


def matrix_digest(packed: DataFrame) -> DataFrame:
    """The rows with the ids replaced by their checksum."""
    return packed.select("sequence_id", "n_tokens", F.sha2("input_ids", 256).alias("input_ids_sha256"), "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts")
