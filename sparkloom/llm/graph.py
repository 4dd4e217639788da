"""Connected components of a graph that only the cluster can hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_arrow
from sparkloom.workspace import materialise

#: Edges up to which one task finds the components: rounds over so few are all waiting for tasks and files.
ONE_TASK = 1 << 16


class Joined(dict):
    """Nodes, each under a smaller one that it is joined with, up to the smallest."""

    def root(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if the two were apart until now."""
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _at_once(edges: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = Joined()
        for b in batches:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                up.join(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([up.root(x) for x in list(up)], pa.int64())], names=["node", "component"])

    return map_arrow(edges.coalesce(1), find, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` → ``(node, component)``: the smallest node reachable, for every node of an edge.

    Alternates large-star and small-star steps until the edges stand still, which takes a number of rounds that grows
    with the logarithm of the largest component. Each round is written, so a lost executor costs one round at most.
    Once there are no more than ONE_TASK edges, from the start or after a round, one task does the rest. *edges* are
    read more than once.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if e.count() <= ONE_TASK:
        return _at_once(e)
    e = materialise(e.distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= ONE_TASK:
            return _at_once(e)
        if mark == seen:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = materialise(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    up = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return up.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
