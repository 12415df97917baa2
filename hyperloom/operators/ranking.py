"""Rank correlation of two top lists on growing prefixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _inversions(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j], by merging doubled blocks."""
    x, total, width = x.copy(), 0, 1
    n = len(x)
    while width < n:
        for a in range(0, n, 2 * width):
            left, right = x[a : a + width], x[a + width : a + 2 * width]
            if len(right):
                total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
                x[a : a + 2 * width] = np.sort(x[a : a + 2 * width], kind="stable")
        width *= 2
    return total


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in O(n log n): discordant pairs are inversions of y in the order of (x, y)."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = np.asarray(x)[order], np.asarray(y)[order]
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    ties = lambda v: pairs(np.unique(v, return_counts=True, axis=0)[1].astype(np.int64))
    total, tx, ty, txy = n * (n - 1) // 2, ties(x), ties(y), ties(np.column_stack([x, y]))
    below = float(total - tx) * float(total - ty)
    if below == 0:
        return float("nan")
    return (total - tx - ty + txy - 2 * _inversions(y)) / below**0.5


def prefix_sizes(n: int, points: int = 500) -> list[int]:
    return [int(s) for s in np.unique(np.logspace(0, np.log10(n - 1), points).astype(int) + 1) if s >= 2]


def top_common(degrees: DataFrame, memberships: DataFrame, top_k: int = 1_000_000) -> DataFrame:
    """(node_id, follow_degree, pack_degree) of nodes in both top lists; ties by id."""
    if top_k < 10:
        raise ValueError("top_k must be at least 10")
    a = degrees.select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("follow_degree")).orderBy(F.desc("follow_degree"), "node_id").limit(top_k)
    b = memberships.groupBy(F.col("member_id").alias("node_id")).agg(F.count("*").alias("pack_degree")).orderBy(F.desc("pack_degree"), "node_id").limit(top_k)
    return a.join(b, "node_id")


def kendall_prefixes(common: DataFrame, points: int = 500) -> DataFrame:
    """(ranked_by, n, tau) on the top n of either ranking. The input has at most top_k rows of three
    numbers, a bound of the operator, so every task gets all of it and computes some prefixes."""
    spark = common.sparkSession
    pdf = common.select("node_id", "follow_degree", "pack_degree").toPandas().sort_values("node_id")
    ids, f, p = (pdf[c].to_numpy(dtype=np.int64) for c in ("node_id", "follow_degree", "pack_degree"))
    keys = {"follow_degree": f, "pack_degree": p}
    ranked = {name: (f[order], p[order]) for name, key in keys.items() for order in [np.lexsort((ids, -key))]}
    shared = spark.sparkContext.broadcast(ranked)
    sizes = [(name, n) for n in (prefix_sizes(len(pdf), points) if len(pdf) >= 10 else []) for name in keys]

    def run(batches):
        for part in batches:
            part["tau"] = [kendall_tau_b(*(x[:n] for x in shared.value[name])) for name, n in zip(part["ranked_by"], part["n"], strict=True)]
            yield part

    jobs = spark.createDataFrame(sizes, "ranked_by string, n long")
    return jobs.repartition(max(1, min(len(sizes), 64)), F.xxhash64("ranked_by", "n")).mapInPandas(run, "ranked_by string, n long, tau double")


def log_bins(prefixes: DataFrame, bins: int = 30) -> DataFrame:
    """Mean tau by logarithmic bins of n; the last bin is open to the right, missing values are left out."""
    good = prefixes.where(~F.isnan("tau"))
    span = good.groupBy("ranked_by").agg(F.log10(F.min("n")).alias("lo"), F.log10(F.max("n")).alias("hi"))
    at = F.floor((F.log10("n") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    rows = good.join(F.broadcast(span), "ranked_by").withColumn("bin", F.when(F.col("hi") > F.col("lo"), at).otherwise(0)).where(F.col("bin") < bins)
    return rows.groupBy("ranked_by", "bin").agg(F.avg("tau").alias("mean_tau"), F.count("*").alias("points"))
