"""Groups of linked items: forests inside a task, components over the whole graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from signalframe.llm.common import materialise


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest node index that each of n nodes reaches over the links (a[i], b[i]).

    `root` carries what earlier links have joined. Hooks roots to smaller roots and halves the paths
    until nothing changes, all in array operations; memory is that of the links given.
    """
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of the edges the smallest node it reaches.

    Each round lets every node adopt the neighbour that ranks first, itself included, and replaces the
    edges by edges between the adopted nodes. The ranking is the id in the first round, which finishes
    stars at once, and a new random order afterwards, which removes a constant share of the nodes of any
    graph per round; so the rounds grow with the logarithm of the longest path. Nothing is gathered:
    a hub's edges meet by partial aggregation and by equi-joins against one row per node, which Spark
    may split. Every round is a stored table, so a lost executor repeats one round at most.
    Nulls link nothing; loops and repeated edges change nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = materialise(e)
    adopted: list[DataFrame] = []
    while not e.isEmpty():
        rank = F.col if not adopted else lambda c, k=len(adopted): F.xxhash64(F.lit(k), F.col(c))
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("id"))).alias("first"))
        own = F.struct(rank("a").alias("rank"), F.col("a").alias("id"))
        step = materialise(first.select(F.col("a").alias("node"), F.least(F.col("first"), own)["id"].alias("to")))
        adopted.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(left, "a").join(right, "b").where("ta <> tb")
        e = materialise(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not adopted:
        return spark.createDataFrame([], "node long, component long")
    label = adopted[0]
    for step in adopted[1:]:
        step = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        label = label.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    label = materialise(label) if len(adopted) > 1 else label
    # the last adopted node need not be the smallest of its component
    smallest = label.groupBy("to").agg(F.least(F.min("node"), F.first("to")).alias("component"))
    return label.join(smallest, "to").select("node", "component")
