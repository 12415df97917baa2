"""Statistics of the pack hypergraph: degrees, sizes, pairs, projection, overlaps.

Raw memberships may repeat a (pack, member) row; operators say whether they count
rows or distinct memberships.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

#: Memberships of a block, about, unless one pack has more.
BLOCK_ROWS = 1_000_000
#: Pairs of memberships counted at a time.
STEP = 1_000_000


def pack_degree_distribution(memberships: DataFrame) -> DataFrame:
    """Members by their number of raw rows."""
    return memberships.groupBy("member_id").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("node_count"))


def pack_size_distribution(packs: DataFrame) -> DataFrame:
    return packs.groupBy(F.col("member_count").alias("pack_size")).agg(F.count("*").alias("pack_count"))


def pack_creation_volume(packs: DataFrame) -> DataFrame:
    return packs.groupBy("date_created").agg(F.count("*").alias("pack_count"))


def packs_per_creator(packs: DataFrame) -> DataFrame:
    return packs.groupBy("creator_id").agg(F.count("*").alias("packs_created"))


def creator_ages(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Days from the creator's account to the pack; negative ages stay, unknown accounts go."""
    made = nodes.where("date_created IS NOT NULL").select(F.col("node_id").alias("creator_id"), F.col("date_created").alias("created"))
    return packs.join(made, "creator_id").select("pack_id", F.datediff("date_created", "created").cast("long").alias("account_age_days"))


def pack_summary(packs: DataFrame, memberships: DataFrame, ages: DataFrame) -> DataFrame:
    degrees = memberships.groupBy("member_id").agg(F.count("*").alias("d"))
    a = degrees.agg(F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.avg("d").alias("mean_degree"), F.count("*").alias("members"))
    b = packs.agg(F.count("*").alias("packs"), F.min("member_count").alias("min_size"), F.max("member_count").alias("max_size"), F.avg("member_count").alias("mean_size"))
    c = ages.agg(F.count_if(F.col("account_age_days") < 0).alias("negative_ages"))
    return b.crossJoin(a).crossJoin(c)  # one row each


def packs_of_person(packs: DataFrame, memberships: DataFrame, person: int) -> DataFrame:
    return memberships.where(F.col("member_id") == person).join(packs, "pack_id").select("pack_id", "creator_id", "date_created", "member_count", "date_added")


def comembers(memberships: DataFrame, person: int, limit: int = 20) -> DataFrame:
    mine = memberships.where(F.col("member_id") == person).select("pack_id").distinct()
    rows = memberships.where(F.col("member_id") != person).join(mine, "pack_id")
    return rows.groupBy("member_id").agg(F.count_distinct("pack_id").alias("shared_packs")).orderBy(F.desc("shared_packs"), "member_id").limit(limit)


def _pairs(memberships: DataFrame) -> DataFrame:
    """(pack_id, node_a, node_b), node_a < node_b, for every two rows of a pack."""
    left = memberships.select("pack_id", F.col("member_id").alias("node_a"))
    right = memberships.select("pack_id", F.col("member_id").alias("node_b"))
    return left.join(right, "pack_id").where("node_a < node_b")


def pair_cooccurrence(packs: DataFrame, memberships: DataFrame, max_pack_size: int = 50) -> DataFrame:
    """Histogram of how many raw rows of packs of 2 to ``max_pack_size`` rows each pair shares."""
    if max_pack_size < 2:
        raise ValueError("max_pack_size must be at least 2")
    some = packs.where(F.col("member_count").between(2, max_pack_size)).select("pack_id")
    pairs = _pairs(memberships.join(some, "pack_id")).groupBy("node_a", "node_b").agg(F.count("*").alias("cooccurrence"))
    return pairs.groupBy("cooccurrence").agg(F.count("*").alias("pair_count"))


def sample_large_pack_pairs(members: list[int], sample_size: int, seed: int) -> tuple[list[tuple[int, int]], float]:
    """Distinct unordered pairs of a pack and the weight of each: all of them if they are few."""
    members = sorted(members)
    total = math.comb(len(members), 2)
    if total <= sample_size:
        return [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]], 1.0
    rng, chosen = random.Random(seed), set()
    while len(chosen) < sample_size:
        i, j = rng.sample(range(len(members)), 2)
        chosen.add((members[min(i, j)], members[max(i, j)]))
    return sorted(chosen), total / len(chosen)


def pair_weights(unique: DataFrame, maximum_exact_pack_size: int | None = None, sample_size: int = 1000, seed: int = 0) -> DataFrame:
    """(node_a, node_b, cooccurrence) over distinct memberships: every pair of every pack.

    Only where ``maximum_exact_pack_size`` is given are pairs of a pack beyond it sampled and
    weighted up; the total is rounded half to even and pairs at zero are dropped.
    """
    if maximum_exact_pack_size is None:
        return _pairs(unique).groupBy("node_a", "node_b").agg(F.count("*").alias("cooccurrence"))
    sizes = unique.groupBy("pack_id").agg(F.count("*").alias("n"))
    sized = unique.join(sizes, "pack_id")
    exact = _pairs(sized.where(F.col("n") <= maximum_exact_pack_size)).select("node_a", "node_b", F.lit(1.0).alias("w"))

    def sample(pdf):
        import pandas as pd

        pairs, weight = sample_large_pack_pairs(pdf["member_id"].tolist(), sample_size, seed * 1_000_003 + int(pdf["pack_id"].iloc[0]))
        return pd.DataFrame(pairs, columns=["node_a", "node_b"]).assign(w=weight)

    large = sized.where(F.col("n") > maximum_exact_pack_size).groupBy("pack_id").applyInPandas(sample, "node_a long, node_b long, w double")
    sums = exact.unionByName(large).groupBy("node_a", "node_b").agg(F.bround(F.sum("w"), 0).cast("long").alias("cooccurrence"))
    return sums.where("cooccurrence > 0")


def cooccurrence_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cooccurrence").agg(F.count("*").alias("pair_count"))


def projection_node_stats(projection: DataFrame) -> DataFrame:
    ends = projection.select(F.explode(F.array("node_a", "node_b")).alias("node_id"), "cooccurrence")
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("cooccurrence").alias("strength"))


def projection_degree_distribution(stats: DataFrame) -> DataFrame:
    return stats.groupBy("degree").agg(F.count("*").alias("node_count"))


def projection_check(projection: DataFrame, histogram: DataFrame) -> DataFrame:
    """(edges, pairs, ok): the projection has as many edges as its histogram has pairs."""
    one = projection.agg(F.count("*").alias("edges")).crossJoin(histogram.agg(F.coalesce(F.sum("pair_count"), F.lit(0)).alias("pairs")))  # one row each
    return one.withColumn("ok", F.col("edges") == F.col("pairs"))


def projection_edge(projection: DataFrame, a: int, b: int) -> DataFrame:
    """The weight between two nodes in either order, 0 without an edge."""
    hit = projection.where((F.col("node_a") == min(a, b)) & (F.col("node_b") == max(a, b)))
    return hit.agg(F.coalesce(F.max("cooccurrence"), F.lit(0)).cast("long").alias("cooccurrence"))


def block_overlaps(member: np.ndarray, pack: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left packs, right packs, matrix of their overlaps); within one block only pairs of a lower and a higher pack count."""
    a_packs, a_at = np.unique(pack[left], return_inverse=True)
    b_packs, b_at = np.unique(pack[right], return_inverse=True)
    order = np.argsort(member[right], kind="stable")
    b_member, b_at, b_times = member[right][order], b_at[order], times[right][order]
    low = np.searchsorted(b_member, member[left], "left")
    n = np.searchsorted(b_member, member[left], "right") - low
    total = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(a_packs) * len(b_packs), dtype=np.int64)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
        x = np.repeat(np.arange(at, to), n[at:to])
        y = np.arange(total[at], total[to]) - total[x] + low[x]
        np.add.at(out, a_at[x] * len(b_packs) + b_at[y], times[left][x] * b_times[y])
        at = to
    out = out.reshape(len(a_packs), len(b_packs))
    return a_packs, b_packs, np.where(a_packs[:, None] < b_packs[None, :], out, 0) if left is right else out


def block_pairs(member: np.ndarray, pack: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(left pack, right pack, overlap) arrays of the pairs that share a member, in steps of whole left packs;
    within one block only pairs of a lower and a higher pack."""
    order = np.lexsort((member[left], pack[left]))
    a_pack, a_member, a_times = pack[left][order], member[left][order], times[left][order]
    b_packs, b_at = np.unique(pack[right], return_inverse=True)
    order = np.argsort(member[right], kind="stable")
    b_member, b_at, b_times = member[right][order], b_at[order], times[right][order]
    low = np.searchsorted(b_member, a_member, "left")
    n = np.searchsorted(b_member, a_member, "right") - low
    total = np.concatenate([[0], np.cumsum(n)])
    first = np.concatenate([[0], np.flatnonzero(np.diff(a_pack)) + 1, [len(a_pack)]]) if len(a_pack) else np.array([0])
    k = 0
    while k < len(first) - 1:
        to = max(k + 1, int(np.searchsorted(total[first], total[first[k]] + STEP, "right")) - 1)
        packs, parts = a_pack[first[k:to]], []
        at, end = int(first[k]), int(first[to])
        while at < end:  # more than one part only where one pack has more pairs than a step
            stop = min(end, max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1))
            x = np.repeat(np.arange(at, stop), n[at:stop])
            y = np.arange(total[at], total[stop]) - total[x] + low[x]
            key, inverse = np.unique((np.searchsorted(packs, a_pack[x])) * len(b_packs) + b_at[y], return_inverse=True)
            parts.append((key, np.bincount(inverse, a_times[x] * b_times[y], len(key)).astype(np.int64)))
            at = stop
        key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)
        a, b = packs[key // len(b_packs)] if len(key) else packs[:0], b_packs[key % len(b_packs)] if len(key) else b_packs[:0]
        keep = a < b if left is right else np.ones(len(key), dtype=bool)
        yield a[keep], b[keep], count[keep]
        k = to


def overlaps_by_blocks(rows: DataFrame, blocks: int, s_max: int) -> DataFrame:
    """(pack, s, pairs) from distinct (pack_id, member_id, times): rows without a pack are a histogram
    of clipped overlaps, those with one are that pack's greatest overlap with the packs of one block."""

    def cross(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        member, pack, times, at = (t[c].to_numpy() for c in ("member_id", "pack_id", "times", "block"))
        left = at == t["i"][0].as_py()
        right = left if t["i"][0] == t["j"][0] else ~left
        hist, names = np.zeros(s_max + 1, dtype=np.int64), np.unique(pack)
        most = np.zeros(len(names), dtype=np.int64)
        for a, b, found in block_pairs(member, pack, times, left, right):
            found = np.minimum(found, s_max)
            hist += np.bincount(found, minlength=s_max + 1)
            for side in (a, b):
                np.maximum.at(most, np.searchsorted(names, side), found)
        s = np.flatnonzero(hist[1:]) + 1
        packs, most = names[most > 0], most[most > 0]
        who = pa.concat_arrays([pa.nulls(len(s), pa.int64()), pa.array(packs, pa.int64())])
        return pa.table({"pack": who, "s": pa.array(np.concatenate([s, most]), pa.int64()), "pairs": pa.array(np.concatenate([hist[s], np.zeros(len(most))]).astype(np.int64))})

    # Every block meets every block once, so a row travels once per block, and no pair does.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("pack_id"), F.lit(blocks)))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.select("member_id", "pack_id", "times", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return rows.groupBy("i", "j").applyInArrow(cross, "pack long, s long, pairs long")


def overlaps_by_pairs(rows: DataFrame, s_max: int) -> DataFrame:
    """The same rows by a join of memberships on their members."""
    side = lambda k: rows.select("member_id", F.col("pack_id").alias(f"pack_{k}"), F.col("times").alias(f"times_{k}"))
    both = side("a").join(side("b"), "member_id").where("pack_a < pack_b").groupBy("pack_a", "pack_b")
    ends = both.agg(F.sum(F.col("times_a") * F.col("times_b")).alias("overlap")).select(
        F.inline(F.array(F.struct(F.col("pack_a").alias("pack"), F.lit(1).alias("first")), F.struct(F.col("pack_b").alias("pack"), F.lit(0).alias("first")))), F.least("overlap", F.lit(s_max)).alias("s")
    )
    # One row per pack and overlap: the histogram is a sum of them, the greatest overlap their maximum.
    ends = durable(ends.groupBy("pack", "s").agg(F.sum("first").alias("pairs")))
    hist = ends.groupBy("s").agg(F.sum("pairs").alias("pairs")).select(F.lit(None).cast("long").alias("pack"), "s", "pairs")
    return hist.unionByName(ends.groupBy("pack").agg(F.max("s").alias("s")).select("pack", "s", F.lit(0).cast("long").alias("pairs")))


def s_line_filtered(memberships: DataFrame, s_max: int = 5, max_member_degree: int = 5000, blocks: int | None = None) -> DataFrame:
    """(s, edges, nodes) over raw rows of members with at most ``max_member_degree`` rows; no rows without overlaps."""
    if s_max < 1:
        raise ValueError(f"no threshold up to s_max={s_max}")
    if max_member_degree < 2:
        raise ValueError(f"members of {max_member_degree} rows make no pair")
    return _s_line(memberships, s_max, max_member_degree, blocks)


def s_line_full(unique: DataFrame, s_max: int = 345, blocks: int | None = None) -> DataFrame:
    """(s, edges, nodes) over distinct memberships without a degree limit."""
    if not 1 <= s_max <= 65_535:
        raise ValueError(f"s_max={s_max} is not from 1 to 65535")
    return _s_line(unique, s_max, None, blocks)


def _s_line(memberships: DataFrame, s_max: int, most: int | None, blocks: int | None) -> DataFrame:
    """Pairs fold into a histogram of clipped overlaps and packs into one of their greatest;
    sums from above give the counts for every threshold.

    With ``blocks`` None the rows go the way that moves less: a row per block, or a row per
    pair of memberships of a member. 0 means pairs; any other number is the least of blocks.
    """
    rows = durable(memberships.where("pack_id IS NOT NULL").groupBy("pack_id", "member_id").agg(F.count("*").alias("times")))
    # Sums of rows for the limit, of packs for what moves.
    degrees = rows.groupBy("member_id").agg(F.sum("times").alias("n"), F.count("*").alias("d")).where("n > 1" + (f" AND n <= {most}" if most else ""))
    degrees = durable(degrees.where("d > 1"))
    rows = durable(rows.join(degrees.select("member_id"), "member_id", "left_semi"))
    if blocks != 0:
        d = F.col("d").cast("double")
        size = degrees.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("rows"), F.coalesce(F.sum(d * (d - 1) / 2), F.lit(0.0)).alias("pairs")).first()
        # Pairs are counted sparsely in steps, so only rows bound a block, not its number of packs.
        least = max(1, math.ceil(size["rows"] / BLOCK_ROWS))
        # Fewer blocks than these would not fit into a task.
        blocks = max(blocks, least) if blocks else 0 if size["pairs"] < size["rows"] * least else least
    found = durable(overlaps_by_blocks(rows, blocks, s_max) if blocks else overlaps_by_pairs(rows, s_max))
    zero = F.lit(0).cast("long")
    packs = found.where("pack IS NOT NULL").groupBy("pack").agg(F.max("s").alias("s"))
    by_pack = packs.groupBy("s").agg(F.count("*").alias("n"), zero.alias("e"))
    by_pair = found.where("pack IS NULL").groupBy("s").agg(zero.alias("n"), F.sum("pairs").alias("e"))
    grid = memberships.sparkSession.range(1, s_max + 1).select(F.col("id").alias("s"), zero.alias("n"), zero.alias("e"))
    hist = by_pack.unionByName(by_pair).unionByName(grid).groupBy("s").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))  # at most s_max rows
    above = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = hist.select("s", F.sum("e").over(above).alias("edges"), F.sum("n").over(above).alias("nodes"), F.sum("e").over(total).alias("any"))
    return out.where("any > 0").select("s", "edges", "nodes")


def s_line_density(s_line: DataFrame, pack_count: int) -> DataFrame:
    return s_line.select("s", (F.col("edges") / F.lit(math.comb(pack_count, 2))).alias("density"))
