"""Connected components of an edge list, by alternating stars.

Every round is two joins and two aggregations whose results are written to the shared folder, so no round depends on an executor that
may be lost. Edges are first contracted inside their partitions (a forest of at most one edge a node). A node's neighbours are never
gathered: a hub's minimum is an aggregation with partial sums, and the minima of hubs, of which there are few, are broadcast to its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import skew
from tesserae.session import keep


class Forest:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite each a[i] with b[i]."""
        while len(a):
            a, b = self.find(a), self.find(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            if not open_.any():
                return
            low, high = low[open_], high[open_]
            np.minimum.at(self.root, high, low)
            a, b = high, low

    def labels(self) -> np.ndarray:
        self.root = self.find(self.root)
        return self.root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's edges, as edges to the smallest node."""
    for b in batches:
        ends = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)])
        nodes, where = np.unique(ends, return_inverse=True)
        where = where.reshape(ends.shape)
        forest = Forest(len(nodes))
        forest.join(where[0], where[1])
        low = nodes[forest.labels()]
        open_ = low != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[open_], pa.int64()), pa.array(low[open_], pa.int64())], ["u", "v"])


def _sum(pairs: DataFrame) -> tuple:
    """Number of the edges and a sum over them, to tell two rounds apart."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, contracted: bool = False, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (two long columns). Nulls and loops are left out."""
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    if not contracted:
        pairs = pairs.mapInArrow(_contract, "u long, v long")
    pairs = keep(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _sum(pairs)
    edges_now = seen[0]
    for _ in range(max_rounds):
        # Large star: what lies above a node moves to the smallest of its neighbourhood.
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("many")), "least")
        large = skew.join_unique(both.where("v > u"), low, ["u"], "many", 2 * edges_now).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "large")
        # Small star: what lies below a node, and the node, move to the smallest of those.
        least = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")), "least")
        met = skew.join_unique(large, least, ["u"], "many", large.count())
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = keep(small, "edges")
        now = _sum(new)
        pairs, settled = new, now == seen
        seen, edges_now = now, now[0]
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
