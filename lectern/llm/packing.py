"""Best-fit-decreasing packing with a segment tree over remaining capacities (operator 9), and the token pieces it packs.

1. A task tokenises its documents, cuts overlong ones, and packs every GROUP_TOKENS tokens it has read: nothing is
   shuffled, what a task holds is bounded by tokens, and neither a hot key nor repeated rows can gather in one group.
2. The outcome is written to the shared folder, so that a task that runs again cannot deal rows anew.
3. Sequences that were left with an eighth of their room or more, a few for each run, are packed again
   across tasks, dealt by the hash of their sequence into groups of about GROUP_TOKENS tokens. So a table of up to that size
   is one run of best-fit decreasing, however many files it has.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_texts, scratch_path, slices

#: Tokens, and pieces (which can be empty), of one packing run.
GROUP_TOKENS, GROUP_PIECES = 1 << 21, 1 << 17
#: A sequence with at least this share of its capacity left is packed again.
ROOM = 1 / 8


class CapacityTree:
    """Open bins by remaining capacity. Leaf c holds the bins with c units left; an inner node tells whether any leaf below holds one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()  # over capacity
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, bin_id: int) -> None:
        at = self.bins[left]
        at.append(bin_id)
        if len(at) == 1:
            i = left + self.size
            while i and not self.any[i]:
                self.any[i] = 1
                i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need that an open bin has, or -1; logarithmic in the capacity."""
        if need >= len(self.bins):
            return -1
        i, some = need + self.size, self.any
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
        while i < self.size:
            i = 2 * i if some[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, left: int) -> int:
        at = self.bins[left]
        bin_id = at.pop()
        if not at:
            i = left + self.size
            self.any[i] = 0
            i >>= 1
            while i:
                self.any[i] = self.any[2 * i] | self.any[2 * i + 1]
                if self.any[i]:
                    break
                i >>= 1
        return bin_id


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, ties in the given order. Lengths are 0 to capacity."""
    order = np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int32)
    tree, opened = CapacityTree(capacity), 0
    for i in order.tolist():
        n = int(lengths[i])
        left = tree.tightest(n)
        if left < 0:
            left, bin_id, opened = capacity, opened, opened + 1
        else:
            bin_id = tree.take(left)
        bins[i], offsets[i] = bin_id, capacity - left
        if left > n:
            tree.put(left - n, bin_id)
    return bins, offsets


def added_tokens(json_path: str) -> dict[str, int]:
    """Strings that the vocabulary's file sets apart before it splits a text, with their ids."""
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take their surroundings along are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def ranks_encoder(ranks_path: str, pattern: str, json_path: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to ids by a rank file, with the added tokens of the json file of the same vocabulary.

    These are the ids that `tokenizers` gives by that json (tests hold the two equal), about four times as fast.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = added_tokens(json_path) if json_path else {}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        ids = enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)
        return np.asarray(ids, np.uint32)

    return encode


@lru_cache(maxsize=4)
def json_encoder(json_path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by a tokenizers json file, the library left as it is."""
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(json_path)
    return lambda text: np.asarray(enc.encode(text, add_special_tokens=False).ids, np.uint32)


def public_encoder() -> Callable[[str], np.ndarray]:
    """The production vocabulary, found where the worker runs."""
    import public_tokenizers as P

    return ranks_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json"))


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the remainder first, then whole sequences; nothing is lost."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


class Run:
    """Pieces of a task that are packed together: columns, and after pack() their sequences and offsets."""

    def __init__(self) -> None:
        self.doc_id: list[int | None] = []
        self.piece: list[int] = []
        self.start: list[int] = []
        self.length: list[int] = []
        self.ids: list[bytes] = []
        self.tokens = 0

    def pack(self, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin and offset of each piece, and the tokens in each bin."""
        lengths = np.array(self.length, np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        return bins, offsets, np.bincount(bins, weights=lengths).astype(np.int64)


def packing_runs(batches: Iterator[pa.RecordBatch], encode: Callable[[str], np.ndarray], capacity: int, end_id: int | None, dtype: str = "<u4", group_tokens: int = GROUP_TOKENS) -> Iterator[Run]:
    """The pieces of a task's documents (doc_id, text), a Run each group_tokens tokens. An id that dtype does not hold raises OverflowError."""
    run, most = Run(), np.iinfo(dtype).max
    for whole in batches:
        for batch in slices(whole, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), arrow_texts(batch.column("text")), strict=True):
                ids = encode(text)
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                if len(ids) and int(ids.max()) > most:
                    raise OverflowError("an id does not fit 16 bits; use width=4")
                raw, width = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
                for piece, (start, n) in enumerate(cut_points(len(ids), capacity)):
                    run.doc_id.append(doc_id)
                    run.piece.append(piece)
                    run.start.append(start)
                    run.length.append(n)
                    run.ids.append(raw[width * start : width * (start + n)])
                    run.tokens += n
                if run.tokens >= group_tokens or len(run.length) >= GROUP_PIECES:
                    yield run
                    run = Run()
    if run.length:
        yield run


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def dealt(rows: DataFrame, tokens: str) -> DataFrame:
    """Rows of sequences that are packed again, with the group (grp) of each sequence: about GROUP_TOKENS tokens a group."""
    total = rows.agg(F.sum(tokens)).first()[0] or 0
    return rows.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, math.ceil(total / GROUP_TOKENS)))).cast("long"))


def again_id(group: int) -> int:
    """The first sequence id of a group of the second round; the first round's are the task's number and a count, below."""
    return 1 << 62 | group << 32


PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
OPEN = PACKED.append(pa.field("open", pa.bool_()))


def pack(docs: DataFrame, capacity: int = 1024, end_id: int | None = 2, encoder: Callable = public_encoder, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens; a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Within a sequence the offsets are gapless from 0; sequence ids are distinct but not dense. Null or
    empty text gives the end id alone (with no end id: one piece of length 0). Repeated rows are packed as often
    as they come, a null doc_id stays null, columns besides doc_id and text are ignored, an empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for run in packing_runs(batches, encoder(), capacity, end_id, "<u4", group_tokens):
            bins, offsets, used = run.pack(capacity)
            crc = [zlib.crc32(x) for x in run.ids]
            columns = (run.doc_id, run.piece, run.start, run.length, crc, bins + base, offsets, capacity - used[bins] >= ROOM * capacity)
            base += len(used)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, OPEN.types, strict=True)], schema=OPEN)

    def second(key: tuple, t: pa.Table) -> pa.Table:
        t = t.select(PACKED.names).sort_by([("sequence_id", "ascending"), ("offset", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit_decreasing(t.column("length").to_numpy(), capacity)
        return t.set_column(5, "sequence_id", pa.array(bins + again_id(key[0].as_py()), pa.int64())).set_column(6, "offset", pa.array(offsets, pa.int64())).cast(PACKED)

    path = scratch_path(docs.sparkSession, "packed")
    texts_of(docs).mapInArrow(first, PACKED_DDL + ", open boolean").write.parquet(path)
    rows = docs.sparkSession.read.schema(PACKED_DDL + ", open boolean").parquet(path)
    return rows.where("not open").drop("open").unionByName(dealt(rows.where("open"), "length").groupBy("grp").applyInArrow(second, PACKED_DDL))
