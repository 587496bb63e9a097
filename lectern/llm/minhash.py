"""Pairs of texts by exact Jaccard similarity of word shingles: what a SimHash radius does not reach (see simhash.one_of_each).

1. Where a text is read: the hashes of its shingles; the hash of their set is its node, so that texts with equal
   sets are one node. BANDS keys of ROWS least hashes each. A pair at the limit of 0.8 shares no key
   with probability (1 - 0.8 ** ROWS) ** BANDS = 1.3e-7, at 0.9 with 1e-15.
2. Nodes that share a key are candidates, whatever the bucket's size; a pair counts only if the exact Jaccard
   similarity of its two shingle sets is at least the limit.
3. First every node of a bucket of the first FIRST_BANDS keys is verified against the bucket's smallest node; then those of all
   keys that nodes of different components still share. No large group of copies is paired.
4. What is then still in different components, in a bucket, is compared by its difference to a hub, the smallest node of the
   component of the bucket's smallest node: the shingles that only one of node and hub has. Let h be (1 - limit) / (1 + limit) and
   e a difference's size. u and v are alike if their sets (of n shingles) differ in at most h * (n_u + n_v) shingles, and what differs between u and v is what
   differs between their differences, so those share at least o = (e_u + e_v - h * (n_u + n_v)) / 2 shingles. If v is not alike the hub,
   e_v > h * (n_v + n_hub), and as e_u >= |n_u - n_hub|, o is above 0: an alike pair, unless both are alike the hub, shares a shingle of its
   differences, and one of the e - o + 1 that are rarest among all differences to that hub (a prefix filter). So a family's common text makes no pairs, and no pair is lost.
5. Pairs that pass have at most h * (n_u + n_v) differing bits in SKETCH bits of parities (what differs in those differs in the sets), and are verified.

Hashes of sets and rows have 64 bits: among ten thousand million texts three pairs of different ones are expected to share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_bytes, scratch_path, slices, stored
from lectern.llm.components import components
from lectern.llm.shingles import majority, shingle_hashes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 5
#: Texts whose shingles a task that verifies pairs keeps.
CACHE_TEXTS = 64
#: Shingles of a difference that one row holds.
LIST = 4096
SKETCH = 1024
#: Taken from real bounds before they are rounded up.
SLACK = 1e-6
#: The keys that are tried first: they link most of a large group of near copies, whose other keys then make no rows.
FIRST_BANDS = 4


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of raw."""
    return np.unique(shingle_hashes(raw, words))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of shingles(); 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def permutations(n: int = BANDS * ROWS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of permutations of 64-bit numbers, the same on every machine."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def band_keys(hashes: np.ndarray, factors: np.ndarray, summands: np.ndarray, rows: int = ROWS) -> list[int]:
    """A signed 64-bit key for each band of rows minima; none of an empty text."""
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[i : i + 512, None] * factors + summands).min(0))
    raw, width = least.tobytes(), 8 * rows
    keys = [xxhash.xxh64_intdigest(raw[i : i + width], i) for i in range(0, len(raw), width)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row; whether each is null counts too."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def marks(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row (row_key), node, fp (the SimHash fingerprint) and keys of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = permutations()
        for whole in batches:
            for b in slices(whole, "text"):
                hashed = [shingle_hashes(x, words) for x in arrow_bytes(b.column("text"))]
                sets = [np.unique(h) for h in hashed]
                fp = np.array([majority(h) for h in hashed], np.uint64).view(np.int64)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(s, *perms) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(node), pa.array(fp), keys], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, row long, node long, fp long, keys array<long>")


def _shingler(words: int) -> Callable[[int, bytes], np.ndarray]:
    """shingles() of a node's text, kept for the last CACHE_TEXTS nodes."""
    cache: dict[int, np.ndarray] = {}

    def of(node: int, raw: bytes) -> np.ndarray:
        if node not in cache:
            if len(cache) >= CACHE_TEXTS:
                del cache[next(iter(cache))]
            cache[node] = shingles(raw, words)
        return cache[node]

    return of


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = texts.toDF("u", "tu"), texts.toDF("v", "tv")
    return pairs.join(a, "u").join(b, "v")


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, limit: float = SIMILARITY) -> DataFrame:
    """The (u, v) of pairs whose shingle sets are at least limit alike. texts: node, text, one row a node."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _shingler(words)
        for b in batches:
            u, v = b.column("u").to_pylist(), b.column("v").to_pylist()
            near = [similarity(of(x, s), of(y, t)) >= limit for x, s, y, t in zip(u, arrow_bytes(b.column("tu")), v, arrow_bytes(b.column("tv")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], schema=schema).filter(pa.array(near, pa.bool_()))

    return _with_texts(pairs, texts).select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of SKETCH classes of shingles whether their number is odd, as signed 64-bit words. Two sets differ in at least as many shingles as their sketches do in bits."""
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def differences(pairs: DataFrame, texts: DataFrame, words: int = WORDS, limit: float = SIMILARITY) -> DataFrame:
    """For each (u, v, root) of pairs: u, v, root, n and hub_n (sizes of the sets of v and u), e (shingles that one of them has), near (at least limit alike),
    the sketch of v's set, and those shingles in rows of at most LIST, numbered by part from 0."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("hub_n", pa.int32()), ("e", pa.int32()), ("near", pa.bool_()), ("sketch", pa.list_(pa.int64())), ("part", pa.int32()), ("tokens", pa.list_(pa.int64()))])
    most = LIST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _shingler(words)
        for b in batches:
            for x, s, y, t, root in zip(b.column("u").to_pylist(), arrow_bytes(b.column("tu")), b.column("v").to_pylist(), arrow_bytes(b.column("tv")), b.column("root").to_pylist(), strict=True):
                hub, own = of(x, s), of(y, t)
                other = np.setxor1d(hub, own, assume_unique=True).view(np.int64)
                row = {"u": x, "v": y, "root": root, "n": len(own), "hub_n": len(hub), "e": len(other), "near": similarity(hub, own) >= limit, "sketch": sketch(own)}
                rows = [row | {"part": i, "tokens": other[i * most : (i + 1) * most]} for i in range(max(1, -(-len(other) // most)))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _with_texts(pairs, texts).select("u", "v", "root", "tu", "tv").mapInArrow(run, "u long, v long, root long, n int, hub_n int, e int, near boolean, sketch array<long>, part int, tokens array<long>")


def _open(seen: DataFrame, roots: DataFrame | None, bands: int, label: str) -> DataFrame:
    """(node, root, low, hub) of the keys, among each node's first bands, that nodes of different components share; low: the key's smallest node, hub: its root. Keys within one component make no rows."""
    nodes = seen.select("node", F.slice("keys", 1, bands).alias("keys"))
    nodes = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = nodes.select("node", "root", F.explode("keys").alias("key"))
    lows = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min(F.struct("node", "root")).alias("low"))
    shared = lows.where("a <> b").select("key", F.col("low.node").alias("low"), F.col("low.root").alias("hub"))
    return stored(keyed.join(stored(shared, f"{label}-keys"), "key").drop("key").distinct(), label)


def links(docs: DataFrame, seen: DataFrame, words: int = WORDS, limit: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """(u, v) of nodes: links that connect all nodes which share a key, or are a pair of more (u, v), and are at least limit alike. seen: marks of docs, stored."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "minhash-links")
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    tried = stored((more if more is not None else seen.limit(0).select(F.col("node").alias("u"), F.col("node").alias("v"))).select(*pair).distinct(), "minhash-tried")
    pairs, roots = tried, None
    for step, bands in enumerate((FIRST_BANDS, BANDS)):  # every node of a bucket against its smallest one
        met = _open(seen, roots, bands, "minhash-buckets")
        new = met.where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
        new = stored(new.distinct().join(tried, ["u", "v"], "left_anti"), "minhash-pairs")
        pairs = tried.unionByName(new) if not step else new
        tried = tried.unionByName(new)
        verified(pairs, _texts(docs, seen, pairs), words, limit).write.parquet(f"{path}/{step}")
        roots = components(spark.read.schema("u long, v long").parquet(*[f"{path}/{i}" for i in range(step + 1)]))
    # Then what is still in different components, by differences to hubs.
    met = _open(seen, roots, BANDS, "minhash-buckets")
    pairs = stored(met.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"), "root").distinct(), "minhash-pairs")
    apart = stored(differences(pairs, _texts(docs, seen, pairs), words, limit), "minhash-differences")
    apart.where("near and part = 0").select(*pair).write.parquet(f"{path}/2")
    pairs = stored(_across(apart, limit).select(*pair).distinct().join(tried, ["u", "v"], "left_anti"), "minhash-pairs")
    verified(pairs, _texts(docs, seen, pairs), words, limit).write.parquet(f"{path}/3")
    return spark.read.schema("u long, v long").parquet(*[f"{path}/{i}" for i in range(4)])


def _texts(docs: DataFrame, seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the nodes in pairs, one row each."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    chosen = seen.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    texts = docs.select(row_key(docs).alias("row"), F.col("text").cast("string").alias("text")).join(chosen, "row").select("node", "text")
    return stored(texts.dropDuplicates(["node"]), "minhash-texts")


def _across(apart: DataFrame, limit: float) -> DataFrame:
    """(u, v): nodes of different components, not both alike their hub, whose differences to it leave room for a similarity of limit. apart: differences()."""
    h = (1 - limit) / (1 + limit)
    tokens = apart.select(F.col("u").alias("hub"), F.col("v").alias("node"), F.explode("tokens").alias("token"))
    # A shingle that one difference alone has comes first in its order and meets no other: only the rest is carried on.
    counts = tokens.groupBy("hub", "token").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(counts, ["hub", "token"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("all"))
    info = apart.where("part = 0").select(F.col("u").alias("hub"), F.col("v").alias("node"), "root", "n", "hub_n", "e", "near", "sketch")
    nodes = info.join(shared, ["hub", "node"]).withColumn("m", F.size("all")).withColumn("w", F.expr(f"e - {h!r}D * n"))

    def first(least: str) -> DataFrame:
        """The shingles among which one is shared if least are."""
        kept = nodes.withColumn("some", F.expr(f"slice(all, 1, greatest(0, m - greatest(1, cast(ceil({least} - {SLACK}) as int)) + 1))"))
        return kept.select("hub", "node", "root", "n", "e", "near", "sketch", "m", "w", F.posexplode("some").alias("k", "one")).withColumn("token", F.col("one.token")).drop("one")

    # Of a pair, a has the smaller w: o is its w at least, and more if it is alike the hub, as b is not. Of b: e less the most that may differ from a.
    a = first(f"greatest(w, if(near, (e + {h!r}D * (hub_n - n)) / 2, w))").alias("a")
    b = first(f"e - {(1 - limit) / limit!r}D * n").alias("b")
    o = f"greatest(1, (a.w + b.w) / 2 - {SLACK})"
    parity = " + ".join(f"bit_count(a.sketch[{i}] ^ b.sketch[{i}])" for i in range(SKETCH // 64))
    same = F.expr("a.hub = b.hub and a.token = b.token")
    room = F.expr(f"a.root <> b.root and not (a.near and b.near) and (a.w < b.w or a.w = b.w and a.node < b.node) and a.k <= a.m - {o} and b.k <= b.m - {o}")
    # Sets whose sizes differ by more than the limit allows cannot be alike.
    alike = F.expr(f"least(a.n, b.n) >= {limit!r}D * greatest(a.n, b.n) - {SLACK} and {parity} <= {h!r}D * (a.n + b.n) + {SLACK}")
    return a.join(b, same & room & alike).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
