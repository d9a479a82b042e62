"""Connected components of a graph that only the cluster holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, table


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one partition as a spanning forest of stars: (node, least node that it reaches here)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 1_000_000:  # memory stays bounded; the rounds below join what this cuts
            yield stars()
    yield stars()


#: Nodes of more edges than this, and than one in MOST_HOT of all edge ends, meet their edges by a broadcast.
HOT, MOST_HOT = 1000, 50_000


def _to_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges (a, b) joined with least (u, m, n) on a = u, as (b, m). n is how many rows of u least has seen.

    A hub's edges would all meet in one task, so nodes with many edges are broadcast, which are fewer than
    2 * MOST_HOT whatever the graph, as each has more than one in MOST_HOT of the `ends`; the others are shuffled.
    """
    limit = max(HOT, ends // MOST_HOT + 1)
    hot, cold = F.broadcast(least.where(F.col("n") > limit)), least.where(F.col("n") <= limit)
    at_hubs = edges.join(hot, F.col("a") == F.col("u"))
    others = edges.join(hot.select("u"), F.col("a") == F.col("u"), "left_anti").join(cold, F.col("a") == F.col("u"))
    return at_hubs.select("b", "m").union(others.select("b", "m"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): component is the least node that node is linked to, directly or not.

    edges: two columns of LONG, in either direction, repeated or not; an edge with a null end or from a node to
    itself is ignored, and nodes without another edge don't appear. Each round contracts every partition's edges
    to stars, then applies large-star and small-star steps: each node's edges move to the least neighbour. Every
    step is an aggregation with map-side combining and an equi-join in which hubs are broadcast. The number of
    rounds grows with the logarithm of the longest path. Each round's edges are written to the shared folder, and
    the round before goes; `release` frees the last when the result has been read.
    """
    first, second = edges.columns[:2]
    e = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a <> b")
    e = table(e.mapInArrow(contract, "a long, b long"), "edges")
    ends = 2 * e.count()
    for _ in range(rounds):
        # large star: from each node, the larger neighbours move to its least neighbour
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        large = _to_least(both.where("b > a"), least, ends).toDF("a", "b")
        # small star: the smaller neighbours and the node itself move to the least of them
        large = large.where("a <> b").dropDuplicates()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), "m", "n")
        small = _to_least(down, least, ends).toDF("a", "b").union(least.select("u", "m"))
        last, e = e, table(small.where("a <> b").dropDuplicates().mapInArrow(contract, "a long, b long").dropDuplicates(), "edges")
        release(last)
        # stars are done when no node is both a centre and a leaf, and each leaf has one centre
        state = e.agg(F.count("*"), F.countDistinct("a")).first()
        ends = 2 * state[0]
        if state[0] == state[1] and e.join(e.select(F.col("b").alias("c")).distinct(), F.col("a") == F.col("c"), "left_semi").isEmpty():
            out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
            out.scratch_path = e.scratch_path
            return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")
