"""Connected components of a graph whose edges don't fit one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import checkpointed

#: Edges that a task contracts at once.
PIECE = 1 << 19
#: Edges of a task that writes a step, and how many tasks write it at least.
TASK_ROWS, LEAST_TASKS = 1 << 16, 8


def contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the same components and no more rows: each piece of a task becomes a star for each of its
    components."""

    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        top = np.array([root(k) for k in range(len(nodes))], np.int64)
        far = np.flatnonzero(top != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[top[far]])], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
            n += b.num_rows
            if n >= PIECE:
                yield star(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield star(*(np.concatenate(x) for x in zip(*held)))

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component's name is its smallest node.

    Without edges that join two nodes there are no rows.  edges are read once.  Tasks first contract their own edges.  Then
    alternates large-star and small-star steps (Kiveris et al., 2014): each replaces a node's edges by edges to the
    smallest node it knows, by one aggregation and one join, without collecting neighbours; each step's edges are
    contracted again by tasks and written to the shared folder, by as many tasks as they need and not as a shuffle has.
    No step makes more edges or larger ends, and one that changes nothing leaves stars, so it ends; it does so as soon as
    every node has one edge down or none, and no end of one has its own.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    e = checkpointed(contracted(edges.distinct()), "edges")
    while True:
        n, open_ = _state(e)
        if not open_:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpointed(contracted(_packed(large, n)), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s")).select(F.col("s.v").alias("u"), F.col("s.m").alias("v"))
        e = checkpointed(contracted(_packed(small.filter("u <> v").distinct(), n)), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return _packed(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), 2 * n)


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """rows, n at most, in no more tasks than they need."""
    return rows.coalesce(max(LEAST_TASKS, -(-n // TASK_ROWS)))


def _state(e: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes don't stand as in stars: with several edges down, or with edges both ways."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(e.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(F.expr("down > 1 OR down = 1 AND least = 0"))).first())
