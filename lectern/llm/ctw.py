"""Context-tree weighting over bytes (operator 10): binary-decomposed bytes, Krichevsky-Trofimov estimates mixed across all depths.

A text is its words, A-Z lower-cased, each with a space after it, then a line feed for its end: so the
model gives a probability to token sequences, as the base does. A byte is eight binary decisions; a node is
(the last d bytes, the decisions made), with counts of zeros and ones from all training documents. Its
weighted probability is half its own estimate, half the product of its deeper contexts'; the posterior
weights of stopping at each depth mix the estimates along the path. A context that training
never saw falls back on its longest seen suffix.

Nothing is cut off, at any size: every window of the corpus is counted and every one gets its exact probability.
1. Each task sorts its windows of DEPTH + 1 bytes and sends distinct ones with their counts: what is gathered grows with the corpus.
2. The tree is grown where its windows are. Windows with the same last TOP context bytes are a block; the nodes of depth TOP
   and deeper are in one block each, and blocks are dealt by a hash. A block with more than HEAVY of all windows is split by one
   more context byte. Above, Spark adds up children; at most 65,280 nodes of depth 1, and 255 of depth 2 for each of at
   most 1 / HEAVY split blocks, reach the driver, and as many go back, whatever the corpus.
3. A second pass over the blocks gives each distinct window its log-probability.
4. Texts are scored where they are read. Windows with at least WINDOW_SHARE of all are looked up in a broadcast of at most
   1 / WINDOW_SHARE entries of 16 bytes; the others, once a text with their count, are joined. Both give the same numbers.
"""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import arrow_bytes, crc_fold, slices, stored

DEPTH, TOP, SLICE, RUN, SLOTS, CODES = 5, 2, 1 << 20, 250_000, 21, 300_000
WINDOWS = 1_500_000  # distinct windows that a task holds before it sends them on
END = b"\n"


def stream(raw: bytes) -> bytes:
    """The bytes that are modelled."""
    words = raw.lower().split()
    return b" ".join(words) + (b" " if words else b"") + END


def windows(streams: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The window (depth earlier bytes, then the byte) of each byte, packed with the byte lowest, and the bounds of each stream in them.

    Before a text stand line feeds. What lies between one stream's end and the next one's begin are windows of those.
    """
    pad = END * depth
    a = np.frombuffer(b"".join([pad + s for s in streams]), np.uint8).astype(np.uint64)
    g = np.zeros(max(0, len(a) - depth), np.uint64)
    for j in range(depth + 1):
        g <<= np.uint64(8)
        g |= a[j : len(a) - depth + j]
    n = np.array([len(s) for s in streams], np.int64)
    begin = np.cumsum(n + depth) - n - depth
    return g, np.stack([begin, begin + n], 1)


def inside(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The windows of the streams' own bytes alone."""
    step = np.zeros(len(g) + 1, np.int8)
    step[bounds[:, 0]] += 1
    step[bounds[:, 1]] -= 1
    return g[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with how often they come or the sum of their counts."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if counts is None:
        v = np.sort(values)
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        return v[edge], np.diff(np.append(edge, len(v)))
    order = np.argsort(values, kind="stable")
    v = values[order]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[edge], np.add.reduceat(counts[order], edge)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of gamma for x >= 0.5, by Stirling's series above 8."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray]]
NONE = np.zeros(0, np.uint64)


def edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def weigh(zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted log-probability, estimate of a one and posterior weight of stopping of nodes; deeper: the log-probability of their children's product."""
    own = log_kt(zeros.astype(np.float64), ones.astype(np.float64))
    kt = (ones + 0.5) / (zeros + ones + 1.0)
    if deeper is None:
        return own, kt, np.ones(len(own))
    weighted = np.logaddexp(own, deeper) - math.log(2)
    return weighted, kt, np.exp(own - math.log(2) - weighted)


def climb(grams: np.ndarray, counts: np.ndarray, bit: int, depth: int, top: int) -> tuple[Levels, tuple[np.ndarray, ...]]:
    """Nodes of one bit from depth top down to depth, (key, estimate, stop) each, and (key, weighted, zeros, ones) at top. A node's key is its context, then the decisions in the lowest byte."""
    levels: Levels = []
    below: tuple[np.ndarray, ...] | None = None
    for d in range(depth, top - 1, -1):
        if below is None:
            g, c = counted(grams, counts)
            byte = (g & np.uint64(0xFF)).astype(np.int64)
            key = (g >> np.uint64(8)) << np.uint64(8) | ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64)
            e = edges(key)  # sorted, as the windows are
            ones = np.add.reduceat(c * ((byte >> (7 - bit)) & 1), e) if len(e) else c
            zeros, deeper = (np.add.reduceat(c, e) - ones if len(e) else c), None
            key = key[e]
        else:
            up = below[0] & np.uint64((1 << 8 * (d + 1)) - 1)
            order = np.argsort(up, kind="stable")
            e = edges(up[order])
            deeper, zeros, ones = (np.add.reduceat(x[order], e) if len(e) else x for x in below[1:])
            key = up[order][e]
        weighted, kt, stop = weigh(zeros, ones, deeper)
        levels.insert(0, (key, kt, stop))
        below = (key, weighted, zeros, ones)
    return levels, below


def descend(levels: Levels, top: int, past: tuple[np.ndarray, ...] | None) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """The mixed probability of a one at each node of levels, which begin at depth top; past: (key, weight left, mixture so far) one depth above. Also that of the last level."""
    mixed = []
    for d, (key, kt, stop) in enumerate(levels, top):
        go, got = np.ones(len(key)), np.zeros(len(key))
        if past is not None:
            at = np.searchsorted(past[0], key & np.uint64((1 << 8 * d) - 1))  # the parent's key: the oldest byte off
            go, got = past[1][at], past[2][at]
        mixed.append((got + go * kt).astype(np.float32).clip(1e-6, 1 - 1e-6))
        past = (key, go * (1 - stop), got + go * stop * kt)
    return mixed, past


@dataclass
class Tree:
    """For each depth and bit: sorted node keys (context, decisions) and the mixed probability of a one there."""

    depth: int
    keys: list[list[np.ndarray]]
    ones: list[list[np.ndarray]]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of each window's byte after the window's context: by the longest context there is of it."""
        out = np.zeros(len(grams))
        byte = (grams & np.uint64(0xFF)).astype(np.int64)
        for k in range(8):
            prefix = ((1 << k) | (byte >> (8 - k))).astype(np.uint64)
            bit = (byte >> (7 - k)) & 1
            p = np.full(len(grams), 0.5)
            todo = np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                keys = self.keys[d][k]
                if not len(todo) or not len(keys):
                    continue
                ctx = (grams[todo] >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
                want = ctx << np.uint64(8) | prefix[todo]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[todo[hit]] = self.ones[d][k][at[hit]]
                todo = todo[~hit]
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def grow(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> Tree:
    """The whole tree of these windows, in one place."""
    keys: list[list[np.ndarray]] = [[] for _ in range(depth + 1)]
    ones: list[list[np.ndarray]] = [[] for _ in range(depth + 1)]
    for k in range(8):
        levels, _ = climb(grams, counts, k, depth, 0)
        for d, ((key, _, _), p) in enumerate(zip(levels, descend(levels, 0, None)[0], strict=True)):
            keys[d].append(key)
            ones[d].append(p)
    return Tree(depth, keys, ones)


@dataclass
class Crown:
    """The tree's nodes above the blocks, by depth and bit, and for each bit what descend() needs of the lowest of them: depths 0 and 1, and depth 2 of the split blocks."""

    keys: list[list[np.ndarray]]
    ones: list[list[np.ndarray]]
    past: list[list[tuple[np.ndarray, ...]]]  # by depth from TOP - 1 on, then bit


@dataclass
class Lookup:
    """Sorted windows with their values, behind a direct-mapped table that is filled once a process: in order, so that the last of a slot stays."""

    keys: np.ndarray
    values: np.ndarray
    order: np.ndarray
    table: tuple[np.ndarray, np.ndarray] | None = None

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each window, 0 where there is none, and the places of those."""
        if not len(self.keys):
            return np.zeros(len(grams)), np.arange(len(grams))
        place = lambda g: ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)
        if self.table is None:
            self.table = np.full(1 << SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << SLOTS, np.float32)
            at = place(self.keys[self.order])
            last = np.zeros(1 << SLOTS, np.int64)
            last[at] = self.order
            self.table[0][at], self.table[1][at] = self.keys[last[at]], self.values[last[at]]
        slot = place(grams)
        out = self.table[1].take(slot).astype(np.float64)
        miss = np.flatnonzero(self.table[0].take(slot) != grams)
        want = grams.take(miss)
        each = counted(want)[0]  # sorted needles keep to the cache
        at = np.minimum(np.searchsorted(self.keys, each), len(self.keys) - 1)
        have = self.keys[at] == each
        back = np.searchsorted(each, want)
        out[miss] = np.where(have, self.values[at], 0.0)[back]
        return out, miss[~have[back]]


def give_back() -> None:
    """Free memory goes back to the system: a worker process that waits for its next task holds none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of finished phases are deleted when the driver's JVM has collected their plans: asked for here, as they are larger than what a phase leaves."""
    gc.collect()
    spark._jvm.System.gc()


def word_key(word: bytes) -> int:
    """A word's 64-bit hash as a signed integer; counts are kept by it."""
    h = xxhash.xxh64_intdigest(word, 7)
    return h - (1 << 64) if h >> 63 else h


class Codes(dict):
    """Words to numbers, in the order they are first met; hashes() of all of them."""

    def __init__(self) -> None:
        super().__init__()
        self.hashed = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code

    def of(self, texts: list[list[bytes]], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, n)

    def hashes(self) -> np.ndarray:
        new = islice(self, len(self.hashed), None)
        self.hashed = np.concatenate([self.hashed, np.fromiter(map(word_key, new), np.int64)])
        return self.hashed


COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64()), ("a", pa.int64())])
WORD, WINDOW = 0, 1
#: A word or window with at least this share of all is looked up in the broadcast, which so has at most 1 / share entries of it.
HEAD_SHARE, WINDOW_SHARE = 5e-7, 1e-7
#: A block with over this share of the distinct windows is split.
HEAVY = 1 / 500


def corpus_counts(docs: DataFrame, depth: int = DEPTH, held_fold: int = 0, folds: int = 10) -> DataFrame:
    """kind, key, n, a: tokens (by hash; an end a document) and windows, with how often training documents and all documents have them."""

    def flush(held: bool, words: Codes, times: np.ndarray, got: list) -> Iterator[pa.RecordBatch]:
        parts = [(WORD, words.hashes(), times)]
        if got:
            g, n = counted(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            parts.append((WINDOW, g.view(np.int64), n))
        for kind, keys, n in parts:
            for i in range(0, len(keys), 1 << 18):
                k, c = keys[i : i + (1 << 18)], n[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(c * (not held)), pa.array(c)], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, got = [Codes(), Codes()], [np.zeros(0, np.int64)] * 2, [[], []]
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                raw, fold = arrow_bytes(b.column("text")), b.column("held_out").to_pylist()
                for h in (0, 1):
                    streams = [stream(x) for x, f in zip(raw, fold, strict=True) if f == bool(h)]
                    if not streams:
                        continue
                    cut = [[*s.split(), END] for s in streams]
                    code = words[h].of(cut, sum(map(len, cut)))
                    more = np.bincount(code, minlength=len(words[h]))
                    more[: len(times[h])] += times[h]
                    times[h] = more
                    got[h].append(counted(inside(*windows(streams, depth))))
                    if sum(len(x[0]) for x in got[h][1:]) > max(500_000, len(got[h][0][0])):
                        got[h] = [counted(np.concatenate([x[0] for x in got[h]]), np.concatenate([x[1] for x in got[h]]))]
                    if len(words[h]) > CODES or len(got[h][0][0]) > WINDOWS:
                        yield from flush(bool(h), words[h], times[h], got[h])
                        words[h], times[h], got[h] = Codes(), np.zeros(0, np.int64), []
            give_back()
        for h in (0, 1):
            yield from flush(bool(h), words[h], times[h], got[h])
        del words, times, got
        give_back()

    rows = docs.select((crc_fold("doc_id", folds) == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    # Each task has added up its own keys: another table of them before the shuffle would only hold memory.
    return rows.mapInArrow(run, "kind byte, key long, n long, a long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


def block_of(bytes_kept: int) -> Column:
    """The last context bytes of a window (key)."""
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * bytes_kept) - 1))


def heavy_blocks(grams: DataFrame, share: float = HEAVY) -> list[int]:
    """Blocks with over share of the distinct windows: fewer than 1 / share."""
    sizes = grams.groupBy(block_of(TOP).alias("block")).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    return sorted(r["block"] for r in sizes.where(F.col("n") > F.lit(share * whole)).collect())


def in_blocks(grams: DataFrame, heavy: list[int], split: bool, columns: list[str]) -> DataFrame:
    """The windows (key) of the heavy or of the other blocks, those of one block together (heavy ones by one byte more), sorted so that they follow each other."""
    chosen = block_of(TOP).isin(heavy) if heavy else F.lit(False)
    rows = grams.where(chosen if split else ~chosen)
    return rows.select(block_of(TOP + split).alias("block"), "key", *columns).repartition("block").sortWithinPartitions("block")


def runs(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = RUN) -> Iterator[list[np.ndarray]]:
    """The columns of whole blocks, about most rows at a time or one block."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([b.column(c).to_numpy() for c in ("block", *columns)])
        rows += b.num_rows
        if rows < most:
            continue
        all_of = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(edges(all_of[0])[-1])
        if cut:
            yield [x[:cut] for x in all_of[1:]]
        held, rows = [[x[cut:] for x in all_of]], len(all_of[0]) - cut
        if not cut:
            most = max(most, 2 * rows)  # a large block: not joined up again for every batch
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)][1:]


NODES = pa.schema([("bit", pa.int8()), ("key", pa.int64()), ("weighted", pa.float64()), ("zeros", pa.int64()), ("ones", pa.int64())])


def children(grams: DataFrame, heavy: list[int], split: bool, depth: int) -> list[np.ndarray]:
    """bit, key, and the children's log-probability, zeros and ones of the nodes right above the (heavy or other) blocks."""
    top = TOP + split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in runs(batches, ["key", "n"]):
            for k in range(8):
                at, weighted, zeros, ones = climb(key.view(np.uint64), n, k, depth, top)[1]
                for i in range(0, len(at), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[part]), k, np.int8)), pa.array(at[part].view(np.int64)), pa.array(weighted[part]), pa.array(zeros[part]), pa.array(ones[part])], schema=NODES)

    nodes = in_blocks(grams.where("n > 0"), heavy, split, ["n"]).mapInArrow(run, "bit byte, key long, weighted double, zeros long, ones long")
    # Decimals add up alike in any order.
    up = F.col("key").bitwiseAND(F.lit((1 << 8 * top) - 1)).alias("key")
    t = nodes.groupBy("bit", up).agg(F.sum(F.col("weighted").cast("decimal(28,6)")).cast("double").alias("weighted"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    return [t.column(c).to_numpy() for c in ("bit", "key", "weighted", "zeros", "ones")]


def _level(columns: list[np.ndarray], depth: int) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """(key, estimate, stop) of the nodes of a depth by (key, deeper, zeros, ones) of parts of them, in any order; and (key, weighted, zeros, ones)."""
    key = columns[0] & np.uint64((1 << 8 * (depth + 1)) - 1)
    order = np.argsort(key, kind="stable")
    e = edges(key[order])
    deeper, zeros, ones = [np.add.reduceat(x[order], e) if len(e) else x for x in columns[1:]]
    weighted, kt, stop = weigh(zeros, ones, deeper)
    return (key[order][e], kt, stop), [key[order][e], weighted, zeros, ones]


def grow_crown(grams: DataFrame, heavy: list[int], depth: int = DEPTH) -> Crown:
    """The nodes above the blocks. grams: key, n of all training windows."""
    light = children(grams, heavy, False, depth)
    split = children(grams, heavy, True, depth) if heavy else [x[:0] for x in light]
    out = Crown([[] for _ in range(TOP + 1)], [[] for _ in range(TOP + 1)], [[], []])
    for k in range(8):
        of = lambda columns: [columns[1][columns[0] == k].view(np.uint64), *(x[columns[0] == k] for x in columns[2:])]  # noqa: B023, E731
        lowest, below = _level(of(split), TOP)
        below = [np.concatenate(x) for x in zip(of(light), below, strict=True)]
        levels: Levels = []
        for d in range(TOP - 1, -1, -1):
            level, below = _level(below, d)
            levels.insert(0, level)
        mixed, past = descend(levels, 0, None)
        more, past_split = descend([lowest], TOP, past) if len(past[0]) else ([np.zeros(0, np.float32)], past)
        for d, (level, p) in enumerate(zip([*levels, lowest], [*mixed, *more], strict=True)):
            out.keys[d].append(level[0])
            out.ones[d].append(p)
        out.past[0].append(past)
        out.past[1].append(past_split)
    return out


def window_scores(grams: DataFrame, depth: int = DEPTH, heavy_share: float = HEAVY) -> DataFrame:
    """key, a and v of all windows (key, n, a): v is the log10 probability of the window's byte; n is 0 for windows training does not have."""
    heavy = heavy_blocks(grams, heavy_share) if depth > TOP else []
    shared = grams.sparkSession.sparkContext.broadcast(grow_crown(grams, heavy, depth))
    let_go(grams.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("v", pa.float32())])

    def scored(split: bool) -> DataFrame:
        top = TOP + split

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            crown = shared.value
            for key, n, a in runs(batches, ["key", "n", "a"]):
                g, seen = key.view(np.uint64), n > 0
                keys, ones = [list(x) for x in crown.keys[:top]], [list(x) for x in crown.ones[:top]]
                keys += [[] for _ in range(top, depth + 1)]
                ones += [[] for _ in range(top, depth + 1)]
                for k in range(8):
                    levels, _ = climb(g[seen], n[seen], k, depth, top)
                    for d, (level, p) in enumerate(zip(levels, descend(levels, top, crown.past[split][k])[0], strict=True), top):
                        keys[d].append(level[0])
                        ones[d].append(p)
                v = Tree(depth, keys, ones).log10(g).astype(np.float32)
                for i in range(0, len(g), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(a[part]), pa.array(v[part])], schema=schema)

        return in_blocks(grams, heavy, split, ["n", "a"]).mapInArrow(run, "key long, a long, v float")

    return scored(False).unionByName(scored(True)) if heavy else scored(False)


def _sorted_by_key(df: DataFrame, *values: str) -> list[np.ndarray]:
    t = df.select("key", *values).toArrow()
    order = np.argsort(t.column("key").to_numpy())
    return [t.column(c).to_numpy()[order] for c in ("key", *values)]


TAIL = pa.struct([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])


def tails(rows: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Array:
    """A list for each of rows texts of what was not looked up, each once with its count. parts: kind, and the text and key of each occurrence."""
    doc, kind, key, n = [], [], [], []
    for which, at, keys in parts:
        order = np.lexsort((keys, at))
        d, k = at[order], keys[order]
        e = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])) if len(d) else np.zeros(0, np.int64)
        doc.append(d[e])
        kind.append(np.full(len(e), which, np.int8))
        key.append(k[e])
        n.append(np.diff(np.append(e, len(d))))
    doc, kind, key, n = (np.concatenate(x) for x in (doc, kind, key, n))
    order = np.argsort(doc, kind="stable")
    ends = np.searchsorted(doc[order], np.arange(rows + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(kind[order], pa.int8()), pa.array(key[order], pa.int64()), pa.array(n[order], pa.int64())], fields=list(TAIL))
    return pa.ListArray.from_arrays(pa.array(ends), inner)


def scores(docs: DataFrame, depth: int = DEPTH, held_fold: int = 0, folds: int = 10, word_share: float = HEAD_SHARE, window_share: float = WINDOW_SHARE, heavy_share: float = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    Null and empty texts are one end token. With no training document every count is 0: base_score is that
    of the smoothing alone and every bit has probability 1/2. Repeated rows are scored each; other columns are ignored.
    The shares decide what is looked up, what is joined and which blocks are split, not the result. Words and their counts are
    kept by 64-bit hashes: of ten thousand million different words about three pairs share one. depth is 2 to 6.
    """
    if not TOP <= depth <= 6:
        raise ValueError("depth is 2 to 6: windows are kept in 56 bits, so that they sort alike signed and unsigned")
    spark = docs.sparkSession
    counts = stored(corpus_counts(docs, depth, held_fold, folds), "ctw-counts")
    let_go(spark)
    words, grams = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == WINDOW)
    total, everywhere, vocabulary = (x or 0 for x in words.agg(F.sum("n"), F.sum("a"), F.sum((F.col("n") > 0).cast("long"))).first())
    values = stored(window_scores(grams.select("key", "n", "a"), depth, heavy_share), "ctw-windows")
    let_go(spark)
    all_windows = values.agg(F.sum("a")).first()[0] or 0
    word_keys, word_n = _sorted_by_key(words.where(F.col("a") >= F.lit(max(1.0, word_share * everywhere))), "n")
    gram_keys, gram_v, gram_a = _sorted_by_key(values.where(F.col("a") >= F.lit(max(1.0, window_share * all_windows))), "v", "a")
    lookup = Lookup(gram_keys.view(np.uint64), gram_v, np.argsort(gram_a, kind="stable").astype(np.int32))
    shared = spark.sparkContext.broadcast((lookup, word_keys, word_n))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("sums", pa.float64()), ("n_bytes", pa.int64()), ("tail", pa.list_(TAIL))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lookup, keys, n = shared.value
        logs, seen = np.append(np.log10(n + 0.1), 0.0), np.append(n > 0, False)
        row, codes, place = TaskContext.get().partitionId() << 33, Codes(), np.zeros(0, np.int64)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                streams = [stream(x) for x in arrow_bytes(b.column("text"))]
                cut = [[*s.split(), END] for s in streams]
                lengths = np.array([len(x) for x in cut], np.int64)
                if len(codes) > CODES:
                    codes, place = Codes(), np.zeros(0, np.int64)
                c = codes.of(cut, int(lengths.sum()))
                hashed = codes.hashes()
                new = hashed[len(place) :]
                at = np.minimum(np.searchsorted(keys, new), max(0, len(keys) - 1))
                place = np.concatenate([place, np.where(keys[at] == new, at, len(keys)) if len(keys) else np.zeros(len(new), np.int64)])
                p, begin = place[c], np.cumsum(lengths) - lengths  # a text has a token at least
                rare = np.flatnonzero(p == len(keys))
                g, bounds = windows(streams, depth)
                value, missed = lookup.get(g)
                doc = np.searchsorted(bounds[:, 0], missed, "right") - 1
                own = (doc >= 0) & (missed < bounds[doc, 1])
                missed, doc = missed[own], doc[own]
                tail = tails(len(cut), [(WORD, np.searchsorted(begin, rare, "right") - 1, hashed[c[rare]]), (WINDOW, doc, g[missed].view(np.int64))])
                sums = np.add.reduceat(np.append(value, 0.0), bounds.ravel())[::2]
                ids = np.arange(row, row + len(cut))
                row += len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("doc_id"), b.column("held_out"), pa.array(lengths), pa.array(np.add.reduceat(seen[p].astype(np.int64), begin)), pa.array(np.add.reduceat(logs[p], begin)), pa.array(sums), pa.array([len(s) for s in streams], pa.int64()), tail], schema=schema)
            give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", folds) == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    # Written once: the row numbers, which a second run of a task could give otherwise, are fixed from here on.
    scored = stored(narrow.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, sums double, n_bytes long, tail array<struct<kind:tinyint,key:bigint,n:bigint>>"), "ctw-scored")
    shared.destroy()
    of_words = words.select("kind", "key", F.log10(F.col("n") + 0.1).alias("v"), (F.col("n") > 0).alias("met"))
    of_grams = values.select(F.lit(WINDOW).cast("byte").alias("kind"), "key", F.col("v").cast("double").alias("v"), F.lit(False).alias("met"))
    tail = scored.select("row", F.inline("tail")).withColumnRenamed("n", "times").join(of_words.unionByName(of_grams), ["kind", "key"])
    part = lambda c, kind: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    sums = tail.groupBy("row").agg(part(F.when(F.col("met"), F.col("times")).otherwise(0), WORD).alias("more"), part(F.col("times") * F.col("v"), WORD).alias("more_logs"), part(F.col("times") * F.col("v"), WINDOW).alias("more_sums"))
    joined = scored.drop("tail").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    smooth, score = math.log10(total + 0.1 * (vocabulary + 1)), plus("sums", "more_sums")
    return joined.select(
        "doc_id", "held_out", "n_tokens", plus("known", "more").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (plus("logs", "more_logs") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"), score.alias("score"), (-score / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
