"""Connected components of link tables, distributed: alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(pmod(xxhash64(u, v), 1000000007) as decimal(38, 0)))")).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable, for every node of a link.

    Each round is two joins on a node with that node's smallest neighbour. The rounds grow
    with the logarithm of the nodes, every round is written to the shared folder, and a node
    with very many links is a skewed join that adaptive execution splits. Null ends and
    links of a node with itself are ignored.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    before = None
    while (now := _state(e)) != before:
        before, rows = now, now[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), rows=rows)
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), rows=rows)
        floor = stored(large.groupBy("u").agg(F.min("v").alias("m")), rows=rows)
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.withColumnRenamed("m", "v"))
        after = stored(small.distinct(), rows=rows)
        for t in (e, least, large, floor):
            drop(t)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def roots(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a-b, and those that start stands for."""
    root = np.arange(n) if start is None else start
    if len(a):
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while True:
                up = new[new]
                if (up == new).all():
                    break
                new = up
            if (new == root).all():
                break
            root = new
    return root
