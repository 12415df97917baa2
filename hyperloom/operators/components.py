"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; the component is its least node.

    Self-loops give components of one node; edges with a null end are ignored.
    Each round keeps minima only, pre-aggregated by task, and is written to the
    shared folder, so a hub costs its edges once and lost executors cost a round.
    """
    raw = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    loops = raw.where("x = y").select(F.col("x").alias("node")).distinct()
    e = durable(raw.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    before = None
    while (now := _state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written first: a join of two shuffles can split a hub's edges, one with an aggregate can't.
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.where("a <> b").distinct())
        low = durable(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = durable(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    linked = found.unionByName(roots)
    alone = loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)


#: Edges whose components are found in one task.
MOST_LOCAL_EDGES = 20_000_000


def least_of_component(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of nodes 0..n-1 linked by edges a, b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return root


def components_on_arrays(edges: DataFrame, src: str = "a", dst: str = "b", most_local: int = MOST_LOCAL_EDGES) -> DataFrame:
    """connected_components() of the same edges, in one task if they are at most ``most_local``."""
    edges = durable(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    if edges.count() > most_local:
        return connected_components(edges)

    def run(batches):
        import pyarrow as pa

        a, b = array("q"), array("q")
        for x in batches:
            a.frombytes(x.column(0).to_numpy().tobytes())
            b.frombytes(x.column(1).to_numpy().tobytes())
        if not a:
            return
        a, b = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64)
        names = np.union1d(a, b)
        root = least_of_component(np.searchsorted(names, a), np.searchsorted(names, b), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "component"])

    return edges.selectExpr("CAST(a AS long) AS a", "CAST(b AS long) AS b").repartition(1).mapInArrow(run, "node long, component long")
