"""SimHash near-duplicate groups by pivot distance tables (operator 4).

1. A 64-bit fingerprint per document, where its text is read; only the fingerprint moves on.
2. Equal fingerprints become one node, by a partial aggregate: groups of copies of any size cost one row a task.
3. Pivot tables: the Hamming distances of each node to many reference fingerprints. By the triangle
   inequality, fingerprints d bits apart differ by at most d in every coordinate.
4. Candidates meet in blocks: with 2 flipped bits, 2 of 4 blocks of 16 bits stay equal, so every link
   shares one of 6 keys. A pair goes on if its largest coordinate difference is within the radius, and is
   then verified on the fingerprints.
5. A bucket with more than BUCKET nodes is not paired. Its nodes use themselves and their 64 one-bit
   neighbours as reference fingerprints instead (distance tables of radius 1): two nodes are within
   2 bits exactly if they share one. That is 65 rows a node whatever the bucket's size, and exact.
6. Components of the links, then the smallest doc_id of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import minhash
from lectern.llm.common import arrow_bytes, slices, stored
from lectern.llm.components import components
from lectern.llm.shingles import majority, shingle_hashes

RADIUS, PIVOTS, BUCKET, BLOCKS = 2, 16, 32, 4


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of raw, A-Z lower-cased."""
    return majority(shingle_hashes(raw, words, seed))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row. Null, empty and blank texts have fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                fp = np.array([fingerprint(x, words) for x in arrow_bytes(b.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS, seed: int = 1) -> list[int]:
    """Reference fingerprints, the same on every machine."""
    v = np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64).view(np.int64)
    return [int(x) for x in v]


def pivot_row(fp: str | Column, refs: list[int]) -> Column:
    """The Hamming distances to the reference fingerprints, one array."""
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.array(*[F.bit_count(c.bitwiseXOR(F.lit(r))).cast("byte") for r in refs])


def block_keys(blocks: int = BLOCKS, radius: int = RADIUS) -> list[Column]:
    """A key for each choice of blocks - radius blocks: fp with the other blocks masked out, and the choice's number."""
    width, out = 64 // blocks, []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("k")))
    return out


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, refs: list[int] | None = None) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within radius (2) bits, u < v within small buckets, star-shaped in crowded ones.

    nodes: fp, distinct and not null.
    """
    if radius != 2:
        raise ValueError("the one-bit neighbours are exact for a radius of 2")
    refs = refs or pivots()
    keyed = nodes.select("fp", F.explode(F.array(*block_keys(BLOCKS, radius))).alias("key")).select("fp", "key.t", "key.k")
    # Written, so that the join is of two plain tables and Spark can split a crowded bucket's rows.
    sizes = stored(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    met = stored(keyed.join(sizes, ["t", "k"]), "simhash-buckets")
    small = met.where(F.col("n") <= bucket).select("t", "k", "fp", pivot_row("fp", refs).alias("far"))
    a, b = small.toDF("t", "k", "u", "fu"), small.toDF("t", "k", "v", "fv")
    near = F.forall(F.zip_with("fu", "fv", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d <= radius)
    pairs = a.join(b, ["t", "k"]).where("u < v").where(near).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    crowd = met.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    near_refs = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("ref"))
    star = near_refs.groupBy("ref").agg(F.min("fp").alias("u"), F.count("*").alias("n"), F.collect_list("fp").alias("all")).where("n > 1")
    return pairs.unionByName(star.select("u", F.explode("all").alias("v")).where("u <> v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    component_id is the smallest doc_id among all documents reachable by links of at most 2 differing
    bits, the document's own included; null ids are not counted, so a group of null ids alone has
    null. Repeated rows and equal texts share a component. Empty table: no rows.
    """
    fp = stored(fingerprints(docs), "simhash-fingerprints")
    nodes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    links = near_links(nodes.select("fp"))
    roots = components(links.select("u", "v"))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = stored(labelled.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")  # a plain table again
    classes = labelled.join(lows, "root").select("fp", "component_id")
    return fp.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copies(seen: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes whose fingerprints are within the radius, such that they connect all that are. seen: node and fp, in any number of rows."""
    nodes = seen.select("node", "fp").distinct()
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")), "simhash-copies")
    same = nodes.join(fps.where("low <> high"), "fp").where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    a, b = fps.select(F.col("fp").alias("u"), F.col("low").alias("lu")), fps.select(F.col("fp").alias("v"), F.col("low").alias("lv"))
    near = near_links(fps.select("fp")).join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    return same.unionByName(near)


def one_of_each(docs: DataFrame, words: int = minhash.WORDS, limit: float = minhash.SIMILARITY) -> DataFrame:
    """One row of each component of texts whose sets of word shingles have a Jaccard similarity of limit or more.

    Candidates are the pairs within the fingerprints' radius (copies) and those that share MinHash keys, which a radius of
    this size does not reach: at a similarity of 0.8 two fingerprints differ by 10 bits on average. A pair of either kind counts only
    if its exact similarity is high enough. Of a component that row stays that has the smallest doc_id (null ids last), then the
    smallest hash of its row; rows equal in all columns count once, rows of one doc_id with different texts are treated apart.
    Texts without words are one component. The rows keep their own columns. Empty table: no rows.
    """
    seen = stored(minhash.marks(docs, words), "near-marks")
    roots = components(minhash.links(docs, seen, words, limit, copies(seen)))
    rows = seen.select("doc_id", "row", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("__row"))
    return docs.withColumn("__row", minhash.row_key(docs)).join(keep, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns)
