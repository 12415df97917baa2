import pytest

from hyperloom.plans import catalog
from tests.differential import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
#: Steps that later queries contain are compared there.
NAMES = [n for n in catalog.ORACLES if n not in {"prediction_candidates", "training_sample", "baseline_scores", "observations", "control_pool", "treated_sample"}]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert spark_rows(df) == duck_rows(SF, catalog.ORACLES[name])


def test_every_query_is_named_once():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_components_and_cores_of_the_whole_tables(spark):
    from collections import Counter

    from hyperloom.operators import kcore, scc
    from hyperloom.sources.crosswalk import Tables

    t = Tables(spark, SF)
    follows = {(r.src, r.dst) for r in t.follows.select("src", "dst").collect()}
    packs = [(r.pack_id, r.member_id) for r in t.unique_memberships.collect()]

    def components(edges):
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in parent}

    def sizes(of):
        return Counter(Counter(of.values()).values())

    def histogram(name):
        return {r.component_size: r.component_count for r in catalog.QUERIES[name](spark, SF).collect()}

    first = {}
    for p, m in packs:
        first[p] = min(m, first.get(p, m))
    assert histogram("follow_wcc") == sizes(components(follows))
    assert histogram("pack_components") == sizes(components([(first[p], m) for p, m in packs]))
    assert histogram("follow_scc") == sizes(scc.tarjan(sorted(follows)))
    of = components(follows)
    best = min(set(of.values()), key=lambda c: (-list(of.values()).count(c), c))
    assert {tuple(r) for r in catalog.QUERIES["giant_component"](spark, SF).collect()} == {e for e in follows if of[e[0]] == best}
    want = kcore.peel(packs)
    assert {r.node_id: r.core_number for r in catalog.QUERIES["kcore"](spark, SF).collect()} == want
    assert {r.core_number: r.node_count for r in catalog.QUERIES["kcore_distribution"](spark, SF).collect()} == Counter(want.values())
    updates = {r.node_id: r.core_number_monotone for r in catalog.QUERIES["kcore_local_updates"](spark, SF).collect()}
    top = {r.node_id: r.core_number_monotone for r in catalog.QUERIES["kcore_monotone"](spark, SF).collect()}
    assert updates == top
    assert top.keys() == want.keys() and all(want[m] <= top[m] for m in want)


def test_full_population_study(spark):
    folder = "/root/testdata/sf0.01"
    query = lambda name: catalog.QUERIES[name](spark, folder)
    eligible = {r.node_id for r in query("treatment_eligible").collect()}
    obs = query("observations_full").collect()
    assert len(eligible) > 400 and {r.node_id for r in obs if r.treated} == eligible
    treated = [r.treatment_id for r in query("treated_sample_full").collect()]
    assert sorted(treated) == list(range(1, len(eligible) + 1))
    assert query("matched_pairs_full").count() > 0 and query("paired_effects_full").count() > 0


def test_rank_agreement_takes_the_whole_ranking(spark):
    from hyperloom.operators import ranking
    from hyperloom.plans.network_queries import degrees
    from hyperloom.sources.crosswalk import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    whole = ranking.top_common(degrees(t), t.memberships, 1_000_000).count()
    assert whole > 1000
    got = [r.n for r in catalog.QUERIES["kendall_tau"](spark, "/root/testdata/sf0.01").collect()]
    assert max(got) == ranking.prefix_sizes(whole)[-1] >= whole - 1  # sizes are cut to whole numbers
