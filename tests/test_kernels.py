import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from hyperloom.operators import cohort, community, hyper, kcore, linkpred, network, ranking, scc
from hyperloom.operators.components import connected_components
from hyperloom.storage import durable


def sizes(comp):
    return {r["component_size"]: r["component_count"] for r in kcore.size_histogram(comp).collect()}


def test_components_fixture(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (7, 7), (None, 1)], "a long, b long")
    assert sizes(connected_components(e)) == {3: 1, 2: 1, 1: 1}
    assert connected_components(e.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_scc_fixture(spark, local):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (5, 5), (6, 0)], "src long, dst long")
    assert sizes(scc.strongly_connected_components(e, local)) == {2: 2, 1: 2}


def test_kcore_fixture(spark):
    rows = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    df = spark.createDataFrame(rows, "pack_id long, member_id long")
    assert {r[0]: r[1] for r in kcore.removal_core(df).collect()} == {0: 1, 1: 2, 2: 1, 3: 1}
    mono = {r[0]: r[1] for r in kcore.monotone_core(df).collect()}
    best, seen = {}, 0
    for node, d in kcore.peel(rows).items():
        seen = max(seen, d)
        best[node] = seen
    assert mono == best


def test_monotone_core_random(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(25), rng.randrange(20)) for _ in range(90)})
    got = {r[0]: r[1] for r in kcore.monotone_core(spark.createDataFrame(rows, "pack_id long, member_id long")).collect()}
    best, seen = {}, 0
    for node, d in kcore.peel(rows).items():
        seen = max(seen, d)
        best[node] = seen
    assert got == best


def test_entropy_fixture(spark):
    m = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (2, 9)], "pack_id long, member_id long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node_id long, community long")
    got = {r["pack_id"]: r["normalized_entropy"] for r in community.edge_entropy(m, labels).collect()}
    assert got == {0: pytest.approx(0.5), 1: 0.0}  # pack 2 has an unlabelled member


def test_configuration_keeps_degrees_and_sizes(spark):
    rows = [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (2, 1), (2, 3), (2, 4)]
    out = [tuple(r) for r in community.configuration_rounds(spark.createDataFrame(rows, "pack_id long, member_id long"), 4).collect()]

    assert len(set(out)) == len(rows)
    for k in (0, 1):
        assert {v: sum(x[k] == v for x in out) for v in {x[k] for x in rows}} == {v: sum(x[k] == v for x in rows) for v in {x[k] for x in rows}}


def test_communities_find_two_cliques(spark):
    edges = [(a, b, 1) for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [(0, 10, 1)]
    df = spark.createDataFrame(edges, "node_a long, node_b long, cooccurrence long")
    labels = community.communities(df)
    assert community.modularity(df, labels).first()["modularity"] > 0.4


def test_agreement_of_equal_and_permuted_labels(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "node_id long, community long")
    b = a.selectExpr("node_id", "(community + 1) % 3 AS community")
    r = community.agreement(community.label_contingency(a, b)).first()
    assert r["nmi"] == pytest.approx(1) and r["ari"] == pytest.approx(1)


def test_pair_sampling():
    pairs, w = hyper.sample_large_pack_pairs([1, 2, 3, 4], 10, 0)
    assert len(pairs) == 6 and w == 1.0
    pairs, w = hyper.sample_large_pack_pairs([1, 2, 3, 4], 3, 0)
    assert len(set(pairs)) == 3 and w == 2.0


def test_s_line_fixture(spark):
    rows = [(p, m) for p, ms in enumerate([(0, 1, 2), (1, 2, 3), (2, 3), (4,)]) for m in ms]
    df = spark.createDataFrame(rows, "pack_id long, member_id long")
    got = {r["s"]: (r["edges"], r["nodes"]) for r in hyper.s_line_full(df, 3).collect()}
    assert got == {1: (3, 3), 2: (2, 3), 3: (0, 0)}
    assert hyper.s_line_full(df.where("pack_id = 3"), 3).count() == 0


def test_argument_checks(spark):
    df = spark.createDataFrame([(0, 0)], "pack_id long, member_id long")
    for call in (lambda: hyper.s_line_full(df, 0), lambda: hyper.s_line_filtered(df, 0), lambda: hyper.pair_cooccurrence(df, df, 1), lambda: network.sample_follows(df, 0), lambda: cohort.Config(treatment_rows=5).check(), lambda: ranking.top_common(df, df, 5)):
        with pytest.raises(ValueError):
            call()


def brute_tau(x, y):
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n = len(x) * (len(x) - 1) / 2
    return (c - d) / math.sqrt((n - tx) * (n - ty))


def test_kendall_tau_with_ties():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 57):
        for _ in range(5):
            x, y = rng.integers(0, 8, n), rng.integers(0, 8, n)
            if len(set(x)) > 1 and len(set(y)) > 1:
                assert ranking.kendall_tau_b(x, y) == pytest.approx(brute_tau(x, y))


def test_bands(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        *[cohort.age_band(F.lit(x)).alias(f"a{x}") for x in (90, 91)], *[cohort.degree_band(F.lit(x)).alias(f"d{x}") for x in (99, 100)], *[cohort.size_band(F.lit(x)).alias(f"s{x}") for x in (50, 51)]
    ).first()
    assert list(row) == ["30-90 days", "91-365 days", "10-99", "100-999", "small (<=50)", "medium (51-150)"]


def test_greedy_matching_stays_close_and_respects_reuse():
    z = np.array([0.2, 0.8, 0.21, 0.79])
    t = np.array([1, 1, 0, 0])
    ids = np.arange(4)
    assert [(a, b) for a, b, _ in cohort.greedy_match(z, t, ids, ids + 10, 1.0, 1)] == [(0, 2), (1, 3)]
    one = cohort.greedy_match(np.array([0.0, 0.0, 0.1]), np.array([1, 1, 0]), np.arange(3), np.arange(3), 1.0, 1)
    assert len(one) == 1


def test_propensity_orders_scores(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=2000)
    y = rng.random(2000) < 1 / (1 + np.exp(-x))
    df = spark.createDataFrame([(i, int(b), float(np.exp(v + 5) - 1)) for i, (v, b) in enumerate(zip(x, y, strict=True))], "obs_id long, treated int, f double")
    got = {r["obs_id"]: r["score"] for r in cohort.propensity_scores(df, ["f"]).collect()}
    s = np.array([got[i] for i in range(2000)])
    assert s[x > 1].mean() > s[x < -1].mean() + 0.3


def test_effects(spark):
    rows = spark.createDataFrame([("x", 3.0, 1.0, 10), ("x", 5.0, 2.0, 11)], "k string, t double, c double, control long")
    r = cohort.paired_effect(rows, ["k"], clustered=False).first()
    assert r["mean_difference"] == 2.5 and r["pairs"] == 2 and r["standard_error_method"] == "paired"
    assert r["standard_error"] == pytest.approx(np.std([2, 3], ddof=1) / math.sqrt(2))
    rows = spark.createDataFrame([("x", 3.0, 1.0, 10), ("x", 5.0, 1.0, 10), ("x", 7.0, 2.0, 11)], "k string, t double, c double, control long")
    r = cohort.paired_effect(rows, ["k"]).first()
    d = np.array([2.0, 4.0, 5.0]) - 11 / 3
    assert r["standard_error"] == pytest.approx(math.sqrt(2 * ((d[0] + d[1]) ** 2 + d[2] ** 2)) / 3)
    assert r["standard_error_method"] == "control-cluster-robust"


def test_incidence_fixture(spark):
    h = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 2)], "pack_id long, node_id long")
    got = {(r["node_index"], r["pack_index"]): r["value"] for r in linkpred.incidence(h, linkpred.history_nodes(h), linkpred.history_packs(h)).collect()}
    assert got[(0, 0)] == pytest.approx(1 / 2) and got[(2, 1)] == pytest.approx(1 / math.sqrt(2))


def test_ranking_metrics_fixture(spark):
    scored = spark.createDataFrame([(1, 10, 0, 0.8), (1, 11, 1, 0.7), (1, 12, 0, 0.1)], "pack_id long, node_id long, label int, m double")
    totals = spark.createDataFrame([(1, "test", 4)], "pack_id long, split string, members long")
    r = linkpred.ranking_metrics(linkpred.per_pack_metrics(scored, totals, ["m"], (1, 2)), (1, 2)).first()
    assert (r["hit_at_1"], r["hit_at_2"], r["macro_recall_at_2"], r["candidate_recall"], r["mrr"]) == (0, 1, 0.25, 0.25, 0.5)


def test_features_are_79():
    assert len(linkpred.feature_names()) == 79


def test_embeddings_of_separate_groups(spark):
    """Three groups that share no pack have three singular values of 1: cosines are 1 inside a group and 0 across."""
    rng = np.random.default_rng(0)
    rows = sorted({(10 * g + int(p), 10 * g + n) for g in range(3) for n in range(10) for p in rng.permutation(8)[:4]})
    h = spark.createDataFrame(rows, "pack_id long, node_id long")
    nodes, packs = durable(linkpred.history_nodes(h)), linkpred.history_packs(h)
    vec = linkpred.embeddings(durable(linkpred.incidence(h, nodes, packs)), nodes, linkpred.Config(dimensions=3, iterations=16))
    got = {r["node_id"]: r["embedding"] for r in vec.collect()}
    e = np.array([got[n] for n in range(30)])
    assert np.allclose(e @ e.T, np.kron(np.eye(3), np.ones((10, 10))), atol=0.02)


def test_core_numbers_by_local_updates_equal_peeling(spark):
    import random

    from hyperloom.operators import kcore

    rng = random.Random(8)
    for n_packs, n_members, most in ((30, 20, 6), (60, 15, 4), (25, 40, 9)):
        rows = {(p, rng.randrange(n_members)) for p in range(n_packs) for _ in range(rng.randrange(1, most))}
        df = spark.createDataFrame(sorted(rows), "pack_id long, member_id long")
        want = {r.node_id: r.core_number_monotone for r in kcore.monotone_core(df).collect()}
        assert {r.node_id: r.core_number_monotone for r in kcore.monotone_core(df, most_local=0).collect()} == want
    assert kcore.local_updates(df.limit(0)).count() == 0


def test_a_component_too_large_to_peel_is_an_error(spark):
    import pytest

    from hyperloom.operators import kcore

    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "pack_id long, member_id long")
    with pytest.raises(ValueError, match="more than 2 rows"):
        kcore.removal_core(df, most_local=2)


def test_indexed_lookups_read_one_bucket(spark):
    import datetime
    import io
    from contextlib import redirect_stdout

    from hyperloom.functions import persons

    day = datetime.date(2024, 1, 1)
    follows = spark.createDataFrame([(a, b, day) for a in range(60) for b in range(60) if (a * b) % 7 == 3], "src long, dst long, date_followed date")
    adjacency = persons.Adjacency(follows, 16)
    other = persons.Adjacency(follows.where("src = 1"), 16)
    got = adjacency.query("SELECT * FROM followers_of(5)")
    assert {r.node_id for r in got.collect()} == {a for a in range(60) if a * 5 % 7 == 3}
    # Plans tell how many buckets are read only where scans of buckets stay such.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    with redirect_stdout(io.StringIO()) as plan:
        adjacency.query("SELECT * FROM followers_of(5)").explain("formatted")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 16" in plan.getvalue()
    assert [r.node_id for r in other.query("SELECT * FROM followers_of(5)").collect()] == []
    assert adjacency.query("SELECT is_following(1, 3) AS x, is_following(1, 4) AS y").first() == (True, False)
    adjacency.drop()
    other.drop()


def test_greedy_match_against_a_plain_version():
    import numpy as np

    from hyperloom.operators.cohort import greedy_match

    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 60))
        z, treated, ids, node = rng.integers(0, 12, n) / 4.0, rng.integers(0, 2, n), rng.permutation(n), rng.integers(0, 15, n)
        caliper, reuse = 0.75, int(rng.integers(1, 4))
        used, want = {}, []
        for k in sorted(np.flatnonzero(treated == 1), key=lambda k: ids[k]):
            near = [(abs(z[j] - z[k]), z[j] >= z[k], j) for j in np.flatnonzero(treated == 0) if abs(z[j] - z[k]) <= caliper and used.get(j, 0) < reuse and node[j] != node[k]]
            if near:
                # The lower side on ties; on it the last of equal ones by id, on the upper side the first.
                d, upper, _ = min(near, key=lambda x: x[:2])
                side = [j for e, u, j in near if (e, u) == (d, upper)]
                best = (min if upper else max)(side, key=lambda j: ids[j])
                used[best] = used.get(best, 0) + 1
                want.append((int(ids[k]), int(ids[best]), float(d)))
        assert greedy_match(z, treated, ids, node, caliper, reuse) == want


@pytest.mark.parametrize("blocks", [0, 1, 3, None])
def test_overlaps_by_blocks_and_by_pairs_against_counting(spark, blocks):
    rng = np.random.default_rng(5)
    # Member 0 is in every pack, and rows repeat.
    rows = [(p, 0) for p in range(40)] + [(int(p), int(m)) for p, m in zip(rng.integers(0, 40, 400), rng.integers(1, 25, 400), strict=True)] + [(41, 99), (None, 3), (3, None)]
    df = spark.createDataFrame(rows, "pack_id long, member_id long")

    def plain(rows, most, s_max):
        times = Counter(r for r in rows if None not in r)
        size = Counter()
        for (_, m), n in times.items():
            size[m] += n
        overlap = Counter()
        for (p, m), n in times.items():
            for (q, k), o in times.items():
                if m == k and p < q and size[m] <= most:
                    overlap[p, q] += n * o
        return {s: (sum(v >= s for v in overlap.values()), len({p for e, v in overlap.items() if v >= s for p in e})) for s in range(1, s_max + 1)}

    got = lambda x: {r["s"]: (r["edges"], r["nodes"]) for r in x.collect()}
    assert got(hyper.s_line_full(df.distinct(), 9, blocks)) == plain(set(rows), 10**9, 9)
    assert got(hyper.s_line_filtered(df, 6, 20, blocks)) == plain(rows, 20, 6)


def test_block_overlaps_in_steps(monkeypatch):
    member, pack = np.array([1, 1, 1, 2, 2, 3]), np.array([10, 11, 12, 10, 12, 11])
    left = np.isin(pack, [10, 11])
    whole = hyper.block_overlaps(member, pack, np.ones(6, dtype=np.int64), left, ~left)
    monkeypatch.setattr(hyper, "STEP", 1)
    parts = hyper.block_overlaps(member, pack, np.ones(6, dtype=np.int64), left, ~left)
    assert whole[2].tolist() == parts[2].tolist() == [[2], [1]]


def test_endpoints_beyond_the_last_node_are_an_error(spark):
    nodes = spark.createDataFrame([(1,), (5,)], "node_id long")
    follows = spark.createDataFrame([(1, 5)], "src long, dst long")
    assert network.check_endpoints(follows, nodes).count() == 1
    with pytest.raises(ValueError, match="last node"):
        network.check_endpoints(spark.createDataFrame([(1, 6)], "src long, dst long"), nodes)
    assert network.check_endpoints(follows.limit(0), nodes.limit(0)).count() == 0


def test_invariants_see_a_change(spark):
    before = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "pack_id long, member_id long")
    seen = lambda rows: {r[0]: r[1] for r in community.configuration_invariants(before, spark.createDataFrame(rows, before.schema)).collect()}
    assert all(seen([(1, 1), (1, 2), (2, 1)]).values())
    assert seen([(1, 1), (1, 1), (2, 2)]) == {"pack_sizes": True, "member_degrees": True, "distinct_memberships": False}
    assert seen([(1, 1), (2, 2), (2, 1)])["pack_sizes"] is False
    assert seen([(1, 3), (1, 2), (2, 1)])["member_degrees"] is False


def test_too_few_matches_are_an_error(spark):
    assert [cohort.least_matches(n) for n in (10, 2000, 10**6)] == [100, 400, 1000]
    assert cohort.enough_matches(spark.range(100), 400).count() == 100
    with pytest.raises(ValueError, match="99 matches"):
        cohort.enough_matches(spark.range(99), 400)
