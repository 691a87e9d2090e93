"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import releasing, written

#: Links that a task contracts together, and the number from which on one task finishes.
LOCAL = 1 << 20


class UnionFind:
    """Union by smaller root over the numbers 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) equivalent to the given ones."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    sets = UnionFind(len(nodes))
    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist()):
        sets.join(x, y)
    roots = np.array([sets.find(i) for i in range(len(nodes))], np.int64)
    other = roots != np.arange(len(nodes))
    return nodes[other], nodes[roots[other]]


def _local(batches):
    held, size = [], 0

    def flush():
        a, b = contract(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size >= LOCAL:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long) that is not the smallest of its component.

    Links are contracted within tasks, at first and after each round of a large and a small star, until
    nothing changes or at most ``LOCAL`` links are left, which one task finishes; each round is written to the shared folder. No group is gathered: the least neighbour of a node comes from a
    partial aggregation and a join.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(releasing(_local), "a long, b long"), name)
    before = None
    while True:
        if edges.count() <= LOCAL:
            done = written(edges.coalesce(1).mapInArrow(releasing(_local), "a long, b long"), name)
            return done.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # a > b holds from here on. Large star: the larger neighbours of each node go to its least one.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct().mapInArrow(releasing(_local), "a long, b long"), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
