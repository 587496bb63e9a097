"""Connected components by alternating large-star and small-star contractions, as joins and aggregates.

Every round is cut off by checkpoint() in the shared folder. No vertex's neighbours are ever gathered in one task: minima are
partial aggregates, and they are handed out by (vertex, salt), so that the edges of a hub are dealt to SALTS tasks
whatever the optimiser does. A graph whose edges have been counted and are few is solved by one task at once, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, stored

SALTS = 64
#: Edges that one task solves: 16 MB of them.
FEW = 1 << 20


def _handed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges with a salt, each u's least v, and that for each (u, salt) there is."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    low = part.groupBy("u").agg(F.min("m").alias("m"))
    return salted, low, part.select("u", "salt").join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    salted, _, handed = _handed(both)
    return salted.where("v > u").join(handed, ["u", "salt"]).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    salted, low, handed = _handed(edges)
    joined = salted.join(handed, ["u", "salt"])
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges and their components' smallest nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _solved(pair: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, roots = solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
            other = nodes != roots
            for i in range(0, len(nodes), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(roots[part])], schema=schema).filter(pa.array(other[part]))

    return stored(pair.coalesce(1).mapInArrow(run, "node long, root long"), "components")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(u, v) links of any order, repeats and loops included, to (node, root): root is the smallest node reachable. Roots and nodes without a link to another are not returned."""
    scratch(edges.sparkSession)
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    if pair.count() <= few:
        return _solved(pair)
    mark = None
    while True:  # every round but the last moves an edge nearer to its root
        pair = _small_star(_large_star(pair).where("u <> v").distinct()).where("u <> v").distinct().checkpoint()
        now = pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return pair.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
