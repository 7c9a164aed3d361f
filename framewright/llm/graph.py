"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.ship import ship

from .common import cut

#: Up to so many links (4 MB) are one task's: rounds over all partitions would write far more, in small files, than the links are.
FEW = 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links ``a``, ``b``, ascending, and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def _connected(batches):
    ends = [np.zeros((2, 0), np.int64), *[np.array([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*np.concatenate(ends, axis=1))], ["node", "root"])


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """node, root (least node of its component) for every node on an edge, the root itself too.

    Up to ``few`` (``FEW``) links are connected by one task, more by alternating stars until nothing changes.
    """
    ship(edges.sparkSession)
    edges = cut(edges.where("a <> b").select("a", "b"))
    if edges.count() <= (FEW if few is None else few):
        return cut(edges.coalesce(1).mapInArrow(_connected, "node bigint, root bigint"))
    edges = _alternated(edges)
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _alternated(edges: DataFrame) -> DataFrame:
    """The same links as stars around the least node of each component."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: what is above a node goes to the least of its neighbourhood.
        sym = both(edges)
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the node and what is below it go to the least of those.
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            return edges
        before = tuple(now)
