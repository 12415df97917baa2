"""Strongly connected components: trimming, then forward-backward colouring.

Nodes without an edge in or out are their own component. In what remains every
node takes the greatest id that reaches it as its colour; the nodes of a colour
that reach its root backwards are the root's component. Found components leave
and the rest goes round again. Every step is a join or a folded aggregate and is
written to the shared folder; a remainder of at most ``MOST_LOCAL_EDGES`` edges,
a checked size, is solved in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable

MOST_LOCAL_EDGES = 1_000_000


def tarjan(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Node -> least node of its strongly connected component."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    root: dict[int, int] = {}
    stack: list[int] = []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        work = [(start, iter(out[start]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    work.append((w, iter(out[w])))
                    break
                if w not in root:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        if part[-1] == v:
                            break
                    least = min(part)
                    root.update(dict.fromkeys(part, least))
    return root


def _local(edges: DataFrame) -> DataFrame:
    def solve(pdf):
        import pandas as pd

        found = tarjan(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)))
        return pd.DataFrame({"node": list(found), "component": list(found.values())})

    return edges.groupBy().applyInPandas(solve, "node long, component long")


def _spread(values: DataFrame, edges: DataFrame, pick) -> DataFrame:
    """Repeat value(dst) = pick(value(dst), values of sources) until nothing changes."""
    while True:
        inbox = edges.join(values.withColumnsRenamed({"node": "src", "value": "v"}), "src").groupBy("dst").agg(pick("v").alias("v"))
        new = durable(
            values.join(inbox.withColumnRenamed("dst", "node"), "node", "left").select(
                "node", F.greatest("value", "v").alias("value"), (F.coalesce(F.col("v") > F.col("value"), F.lit(False))).alias("moved")
            )
        )
        values = new.select("node", "value")
        if new.where("moved").isEmpty():
            return values


def strongly_connected_components(follows: DataFrame, most_local_edges: int = MOST_LOCAL_EDGES) -> DataFrame:
    """Rows (node, component) for every node that touches an edge; the component is its least node."""
    nodes = durable(follows.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct())
    edges = durable(follows.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        while True:  # trim
            before = edges.count()
            live = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node")
            edges = durable(edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            if edges.count() == before:
                break
        if before == 0:
            break
        if before <= most_local_edges:
            part = _local(edges)
            found = part if found is None else found.unionByName(part)
            break
        inside = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(durable(inside.withColumn("value", F.col("node"))), edges, F.max)
        c = lambda k: colour.withColumnsRenamed({"node": k, "value": f"c_{k}"})
        same = durable(edges.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        mark = _spread(durable(colour.select("node", F.when(F.col("node") == F.col("value"), 1).otherwise(0).alias("value"))), back, F.max)
        part = colour.join(mark.where("value = 1").select("node"), "node", "left_semi")
        ids = part.groupBy("value").agg(F.min("node").alias("component"))
        part = durable(part.join(ids, "value").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        edges = durable(edges.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
