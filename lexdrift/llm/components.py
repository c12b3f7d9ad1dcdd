"""Connected components of a distributed list of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def union(n: int, a: list[int], b: list[int]) -> np.ndarray:
    """The least member of each one's component, of n nodes with edges (a, b), within a task."""
    parent = list(range(n))
    for x, y in zip(a, b, strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(n):
        parent[x] = parent[parent[x]]
    return np.array(parent, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b): root is the least node of the component. Nodes without an edge to another are left out.

    A union-find in rounds: each node hooks onto its least neighbour, pointers double, and edges move to the ends' parents; what lies within
    one tree goes. Each round at least halves the trees that still have edges. All tables stay distributed; each round's are written to the
    shared folder.
    """
    e = materialise(edges.select("a", "b").where("a <> b"))
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")))
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        p = materialise(p.join(up, "parent").select("node", F.col("above").alias("parent")))
        maps.append(p)
        at = p.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        bt = p.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        e = materialise(e.join(at, "a").join(bt, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].withColumnRenamed("parent", "root")
    for p in maps[1:]:
        out = out.join(p.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return materialise(out)
