"""Communities of the weighted projection and measures over labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable


def edge_entropy(unique: DataFrame, labels: DataFrame) -> DataFrame:
    """Shannon entropy of each pack's community shares over ln(members).

    Packs with an unlabelled member are left out; one member or one community is 0.
    """
    rows = unique.join(labels, F.col("member_id") == F.col("node_id"), "left").select("pack_id", "community")
    counts = rows.groupBy("pack_id", "community").agg(F.count("*").alias("n"))
    size = F.sum("n")
    # -sum(p ln p) = ln(size) - sum(n ln n) / size
    raw = F.ln(size) - F.sum(F.col("n") * F.ln("n")) / size
    packs = counts.groupBy("pack_id").agg(
        size.alias("member_count"),
        F.count_if(F.col("community").isNotNull()).alias("communities_present"),
        F.count_if(F.col("community").isNull()).alias("unlabelled"),
        raw.alias("raw"),
    )
    value = F.when((F.col("member_count") <= 1) | (F.col("communities_present") <= 1), 0.0).otherwise(F.col("raw") / F.ln("member_count"))
    return packs.where("unlabelled = 0").select("pack_id", "member_count", "communities_present", value.alias("normalized_entropy"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of labels over undirected edges (node_a, node_b), unweighted: sum of L/m - (d/2m)^2."""
    side = lambda k: labels.select(F.col("node_id").alias(k), F.col("community").alias(f"c_{k}"))
    both = edges.select("node_a", "node_b").join(side("node_a"), "node_a").join(side("node_b"), "node_b")
    ends = both.select(F.inline(F.array(*[F.struct(F.col(f"c_{k}").alias("c"), (F.col("c_node_a") == F.col("c_node_b")).cast("int").alias("same")) for k in ("node_a", "node_b")])))
    per = ends.groupBy("c").agg(F.count("*").alias("d"), (F.sum("same") / 2).alias("inside"))
    total = F.sum("d") / 2
    return per.agg((F.sum("inside") / total - F.sum(F.col("d").cast("double") * F.col("d")) / (4 * total * total)).alias("modularity"), F.count("*").alias("communities"))


def label_contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select("node_id", F.col("community").alias("community_b"))
    return a.withColumnRenamed("community", "community_a").join(right, "node_id").groupBy("community_a", "community_b").agg(F.count("*").alias("n"))


def agreement(contingency: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean) and adjusted Rand index of two labelings."""
    n = F.sum("n")
    rows = contingency.groupBy("community_a").agg(n.alias("n"))
    cols = contingency.groupBy("community_b").agg(n.alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    xlogx = lambda c: F.sum(F.col(c) * F.ln(c))
    part = lambda df, k: df.agg(pairs("n").alias(f"p{k}"), xlogx("n").alias(f"h{k}"), F.sum("n").alias(f"n{k}"))
    one = part(contingency, "x").crossJoin(part(rows, "a")).crossJoin(part(cols, "b"))  # one row each
    total = F.col("nx").cast("double")
    h = lambda k: F.ln(total) - F.col(f"h{k}") / total
    mutual = h("a") + h("b") - h("x")
    expected = F.col("pa") * F.col("pb") / (total * (total - 1) / 2)
    top = (F.col("pa") + F.col("pb")) / 2
    return one.select(
        F.when(h("a") + h("b") == 0, 1.0).otherwise(2 * mutual / (h("a") + h("b"))).alias("nmi"),
        F.when(top == expected, 1.0).otherwise((F.col("px") - expected) / (top - expected)).alias("ari"),
    )


def community_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("community").agg(F.count("*").alias("node_count"))


def giant_nodes(components: DataFrame) -> DataFrame:
    """(node) of the largest component (ties: the least id)."""
    best = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(best.select("component")), "component").select("node")


def giant_component(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges of the largest component (ties: the least id)."""
    return edges.join(giant_nodes(components).withColumnRenamed("node", "node_a"), "node_a", "left_semi")


#: Nodes whose labels may lie on the driver and at every worker: 8 bytes each for names, 4 a round.
MOST_LABELS = 5_000_000
#: Links of a partition, about.
PARTITION_LINKS = 2_000_000


def neighbours(edges: DataFrame, names, parts: int) -> DataFrame:
    """(x, v, w): one row per node with the places and weights of all around it."""
    kind = edges.schema["cooccurrence"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def rows(table):
            u = table.column(0).to_numpy()
            first = np.flatnonzero(np.diff(u, prepend=u[0] - 1))
            offsets = pa.array(np.append(first, len(u)).astype(np.int32))
            place = lambda x: np.searchsorted(names.value, x).astype(np.int32)
            w = table.column(2).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(place(u[first])), pa.ListArray.from_arrays(offsets, pa.array(place(table.column(1).to_numpy()))), pa.ListArray.from_arrays(offsets, w)], names=["x", "v", "w"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 500_000:
                continue
            table = pa.Table.from_batches(held)
            u = table.column(0).to_numpy()
            cut = int(np.searchsorted(u, u[-1]))  # the last node may go on
            if cut:
                yield rows(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                n -= cut
        if n:
            yield rows(pa.Table.from_batches(held))

    ways = F.inline(F.array(F.struct(F.col("node_a").alias("u"), F.col("node_b").alias("v")), F.struct(F.col("node_b").alias("u"), F.col("node_a").alias("v"))))
    both = edges.select(ways, F.col("cooccurrence").alias("w")).select(F.col("u").cast("long"), F.col("v").cast("long"), "w")
    return both.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(run, f"x int, v array<int>, w array<{kind}>")


def next_labels(v: np.ndarray, w: np.ndarray, size: np.ndarray, own: np.ndarray, turn: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label after the round, links inside the label before) of nodes with ``size`` links each, which lie one node after another."""
    n = len(label)
    key = np.repeat(np.arange(len(size)), size) * n
    key += label[v]
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total, count = np.add.reduceat(w[by], first), np.diff(first, append=len(key))
    x, c = np.divmod(key[first], n)
    mine, inside, held = c == own[x], np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=total.dtype)
    inside[x[mine]], held[x[mine]] = count[mine], total[mine]
    line = np.flatnonzero(np.diff(x, prepend=-1))
    best = np.maximum.reduceat(total, line)
    hit = np.flatnonzero(total == np.repeat(best, np.diff(line, append=len(x))))
    hit = hit[np.unique(x[hit], return_index=True)[1]]  # labels are in order: the least of the best
    return np.where(turn & (best > held), c[hit], own), inside


def communities(edges: DataFrame, rounds: int = 12, most_labels: int = MOST_LABELS) -> DataFrame:
    """(node_id, community) by weighted label propagation, half the nodes at a time.

    In a round the nodes of one parity (of id hash and round) take the label with
    the greatest total weight around them, ties to the least label, and keep their
    own if it is as good. Halves stop the swapping of two sides. The best labels by
    modularity are returned.

    Up to ``most_labels`` nodes the labels go to every worker, and a round reads each node's
    neighbours once and moves nothing else; beyond it rounds are joins, with the same result.
    """
    import pyarrow as pa

    edges = durable(edges.select("node_a", "node_b", "cooccurrence"))
    spark = edges.sparkSession
    turns = lambda u: sum(((F.pmod(F.xxhash64(u, F.lit(k)), F.lit(2)) == 0).cast("long") * (1 << k) for k in range(rounds + 1)), F.lit(0).cast("long"))
    nodes = durable(edges.select(F.explode(F.array("node_a", "node_b")).alias("u")).groupBy("u").agg(F.count("*").alias("degree")).select("u", "degree", turns(F.col("u")).alias("turns")))
    n = nodes.count()
    if not 0 < n <= most_labels or rounds > 60:
        return communities_by_joins(edges, rounds)
    got = nodes.toArrow()
    ids, degree, turn = (got.column(k).to_numpy() for k in range(3))
    order = np.argsort(ids)
    ids, degree, turn = ids[order].astype(np.int64), degree[order], turn[order]
    two_m = int(degree.sum())
    names = spark.sparkContext.broadcast(ids)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-two_m // PARTITION_LINKS))
    lists = durable(neighbours(edges, names, parts))
    label = np.arange(n, dtype=np.int32)
    best, best_q = label, -1.0
    for k in range(rounds + 1):
        sent = spark.sparkContext.broadcast((label, (turn >> k & 1).astype(bool)))

        def step(batches, sent=sent):
            label, turn = sent.value
            for b in batches:
                x, v, w = (b.column(j) for j in range(3))
                if b.num_rows:
                    x = x.to_numpy()
                    new, inside = next_labels(v.flatten().to_numpy(), w.flatten().to_numpy(), np.diff(v.offsets.to_numpy()), label[x], turn[x], label)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(new.astype(np.int32)), pa.array(inside)], names=["x", "new", "inside"])

        got = lists.mapInArrow(step, "x int, new int, inside long").toArrow()
        sent.destroy()
        d = np.bincount(label, degree, minlength=n)
        q = int(got.column("inside").to_numpy().sum()) / two_m - float((d * d).sum()) / two_m**2 if k else None
        if q is not None and q > best_q:
            best, best_q = label, q
        label = np.empty(n, dtype=np.int32)
        label[got.column("x").to_numpy()] = got.column("new").to_numpy()
    return durable(spark.createDataFrame(pa.table({"node_id": ids, "community": ids[best]})))


def communities_by_joins(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """communities() without labels on the driver."""
    both = durable(
        edges.select(F.inline(F.array(F.struct(F.col("node_a").alias("u"), F.col("node_b").alias("v")), F.struct(F.col("node_b").alias("u"), F.col("node_a").alias("v")))), F.col("cooccurrence").alias("w"))
    )
    labels = durable(both.groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree")).withColumn("community", F.col("node_id")))
    two_m = labels.agg(F.sum("degree")).first()[0]
    best, best_q = labels, -1.0
    for k in range(rounds + 1):
        # One pass has the labels around each node, so the next move, and how good the labels of the last move are.
        seen = both.join(labels.select(F.col("node_id").alias("v"), F.col("community").alias("c")), "v").groupBy(F.col("u").alias("node_id"), "c").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        own = lambda x: F.coalesce(F.max(F.when(F.col("c") == F.col("community"), F.col(x))), F.lit(0))
        each = labels.join(seen, "node_id").groupBy("node_id", "degree", "community").agg(F.max(F.struct("w", (-F.col("c")).alias("neg"))).alias("t"), own("w").alias("own"), own("n").alias("inside"))
        turn = F.pmod(F.xxhash64("node_id", F.lit(k)), F.lit(2)) == 0
        new = F.when(turn & (F.col("t.w") > F.col("own")), -F.col("t.neg")).otherwise(F.col("community"))
        step = durable(each.select("node_id", "degree", "community", "inside", new.alias("new")))
        per = step.groupBy("community").agg(F.sum("degree").cast("double").alias("d"), F.sum("inside").alias("inside"))
        inside, squares = per.agg(F.sum("inside"), F.sum(F.col("d") * F.col("d"))).first()
        q = inside / two_m - squares / two_m**2 if k and two_m else None
        if q is not None and q > best_q:
            best, best_q = step.select("node_id", "community"), q
        labels = step.select("node_id", "degree", F.col("new").alias("community"))
    return best.select("node_id", "community")


def configuration_rounds(unique: DataFrame, rounds: int = 10, seed: int = 0, per_group: int = 64) -> DataFrame:
    """Memberships after random swaps that keep member degrees, pack sizes and distinctness.

    In each round the packs fall into random groups; inside a group neighbouring
    packs (in random order) put the members that only one of them has together and
    deal them out again to the old sizes.
    """
    import zlib

    import numpy as np
    import pandas as pd

    n = unique.select("pack_id").distinct().count()
    groups = max(1, n // per_group)
    rows = durable(unique.select("pack_id", "member_id").distinct())

    def swap_of(k: int):
        def swap(pdf):
            packs = {int(p): set(g) for p, g in pdf.groupby("pack_id")["member_id"]}
            names = sorted(packs)
            rng = np.random.default_rng([seed, k, zlib.crc32(repr(names).encode())])
            order = [names[i] for i in rng.permutation(len(names))]
            for a, b in zip(order[::2], order[1::2], strict=False):
                both = packs[a] & packs[b]
                pool = sorted(packs[a] ^ packs[b])
                size = len(packs[a]) - len(both)
                pool = [pool[i] for i in rng.permutation(len(pool))]
                packs[a], packs[b] = both | set(pool[:size]), both | set(pool[size:])
            out = [(p, m) for p in names for m in sorted(packs[p])]
            return pd.DataFrame(out, columns=["pack_id", "member_id"])

        return swap

    for k in range(rounds):
        group = F.pmod(F.xxhash64("pack_id", F.lit(seed), F.lit(k)), F.lit(groups))
        rows = durable(rows.groupBy(group).applyInPandas(swap_of(k), "pack_id long, member_id long"))
    return rows


def configuration_invariants(before: DataFrame, after: DataFrame) -> DataFrame:
    """(invariant, kept): sizes of packs, degrees of members, and that no membership occurs twice."""

    def same(key: str) -> DataFrame:
        sign = before.select(key, F.lit(1).alias("k")).unionByName(after.select(key, F.lit(-1).alias("k")))
        off = sign.groupBy(key).agg(F.sum("k").alias("k")).where("k <> 0")
        return off.agg((F.count("*") == 0).alias("kept"))

    twice = after.groupBy("pack_id", "member_id").agg(F.count("*").alias("n")).where("n > 1").agg((F.count("*") == 0).alias("kept"))
    parts = {"pack_sizes": same("pack_id"), "member_degrees": same("member_id"), "distinct_memberships": twice}
    named = [df.select(F.lit(name).alias("invariant"), "kept") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def top_communities(labels: DataFrame, k: int = 5) -> DataFrame:
    return community_sizes(labels).orderBy(F.desc("node_count"), "community").limit(k)


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based index in key order without one window over all rows: ranks inside ranges plus the ranges' offsets."""
    parts = durable(df.select(key).distinct().repartitionByRange(key).withColumn("p", F.spark_partition_id()))
    sizes = parts.groupBy("p").agg(F.count("*").alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(key)) - 1
    return parts.withColumn("r", rank).join(offsets, "p").select(key, (F.col("offset") + F.col("r")).alias(name))
