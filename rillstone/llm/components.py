"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small

#: Edges that one task connects without any round; with more, no task holds them.
FEW = 100_000


def _connected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches])
    nodes, at = np.unique(edges[["u", "v"]].to_numpy(np.int64).ravel(), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns u and v); root is the smallest node reachable.

    Self loops and repeated edges are allowed, nulls are not. Every round is a few joins and sums by node, with
    map-side partial sums, and is checkpointed; rounds grow with the logarithm of the longest path. Up to ``FEW`` edges are connected in one task.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    if small(e, FEW):
        return e.coalesce(1).mapInPandas(_connected, "node long, root long")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours all point to the least of them
        joined = large.join(least, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(e.where("u <> v").distinct())
        before, state = state, _state(e)
        if before == state:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
