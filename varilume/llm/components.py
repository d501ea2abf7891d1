"""Connected components: small graphs in one task, larger ones by alternating star contraction in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varilume.llm.common import cut

#: Edges that one task joins at once (16 bytes each), without a job for each round.
SMALL = 1 << 19


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of edges: roots hook onto smaller ones, paths are halved until none is left."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(x):
        a, b = root[x], root[y]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def _at_once(edges: DataFrame) -> DataFrame:
    def f(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in least_reachable(*(np.concatenate(c) for c in zip(*parts, strict=True)))], ["node", "component"])

    return cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInArrow(f, "node long, component long"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    Up to SMALL edges go to one task; of more, rounds are logarithmic in the longest path. Only a count and a checksum reach the driver.
    Loops and repeated edges are allowed; a null end drops the edge; no edge gives no row.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    now = cut(ends.filter("a is not null and b is not null and u != v").select("u", "v").distinct())
    seen = _digest(now)
    if 0 < seen[0] <= SMALL:
        return _at_once(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)))
        state = _digest(now)
        if state == seen:
            break
        seen = state
    # a star: every u points at its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
