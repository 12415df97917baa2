"""Label propagation: what it reads, and its result."""

import random

import numpy as np
from pyspark.sql import functions as F

from hyperloom.operators import community, hyper
from hyperloom.operators.components import components_on_arrays, connected_components


def test_edges_are_made_once_and_the_best_round_counts(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(90)})
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(a, b, 1 + (a * b) % 3) for a, b in pairs], "node_a long, node_b long, w long").select("node_a", "node_b", counted.asNondeterministic()("w").alias("cooccurrence"))
    found = {r.node_id: r.community for r in community.communities(edges, rounds=4).collect()}
    assert made.value == len(pairs)
    turns = [{r.node_id: r.h for r in spark.createDataFrame([(x,) for x in range(24)], "node_id long").select("node_id", F.pmod(F.xxhash64("node_id", F.lit(k)), F.lit(2)).alias("h")).collect()} for k in range(4)]
    label = {x: x for e in pairs for x in e}
    best, best_q = None, -1.0
    for k in range(4):
        new = {}
        for x, own in label.items():
            w = {}
            for a, b in pairs:
                if x in (a, b):
                    c = label[a + b - x]
                    w[c] = w.get(c, 0) + 1 + (a * b) % 3
            top = max(w, key=lambda c: (w[c], -c))
            new[x] = top if turns[k][x] == 0 and w[top] > w.get(own, 0) else own
        label, m = new, len(pairs)
        q = sum(label[a] == label[b] for a, b in pairs) / m - sum(sum((a in s) + (b in s) for a, b in pairs) ** 2 for c in set(label.values()) for s in [{x for x in label if label[x] == c}]) / (2 * m) ** 2
        if q > best_q + 1e-12:
            best, best_q = label, q
    assert found == best
    assert community.communities(edges.limit(0)).count() == 0


def test_the_projection_has_every_pair_of_a_large_pack(spark):
    n = 4_070
    df = spark.range(n).selectExpr("1L AS pack_id", "id AS member_id").unionByName(spark.range(2).selectExpr("2L AS pack_id", "id AS member_id"))
    pairs = hyper.pair_weights(df)
    assert tuple(pairs.agg(F.count("*"), F.sum("cooccurrence")).first()) == (n * (n - 1) // 2, n * (n - 1) // 2 + 1)


def test_labels_at_the_workers_equal_those_by_joins(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(0, 900, 3), 2))) for _ in range(1500)})
    edges = spark.createDataFrame([(a, b, 1 + (a * b) % 4) for a, b in pairs], "node_a long, node_b long, cooccurrence long")
    want = community.communities(edges, rounds=5, most_labels=0).collect()
    got = community.communities(edges, rounds=5).collect()
    assert sorted(got) == sorted(want) and len(got) == len({x for e in pairs for x in e})
    w = np.array([1, 1, 2, 3, 3])
    new, inside = community.next_labels(np.array([1, 2, 0, 0, 1]), w, np.array([2, 1, 2]), np.array([0, 1, 2]), np.array([True, True, False]), np.arange(3))
    assert new.tolist() == [1, 0, 2] and inside.tolist() == [0, 0, 0]


def test_components_on_arrays_equal_those_by_rounds(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(500, 500), (None, 3), (4, None)] + [(k, k + 1) for k in range(1000, 1100)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = sorted(connected_components(edges).collect())
    assert sorted(components_on_arrays(edges).collect()) == want
    assert sorted(components_on_arrays(edges, most_local=3).collect()) == want
