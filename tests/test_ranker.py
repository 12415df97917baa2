"""Embeddings and the ranker on arrays against their distributed forms."""

import numpy as np
import pytest

from hyperloom.operators import linkpred as p
from hyperloom.plans.linkpred_queries import Study
from hyperloom.sources.crosswalk import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    return Study(Tables(spark, SF), p.Config(clusters=4, dimensions=4, iterations=3), learned=True)


def unit_rows(df):
    return np.array([r.embedding for r in df.orderBy("node_id").collect()], dtype=float)


@pytest.mark.parametrize("step", [7, p.STEP])
def test_embeddings_in_one_task_equal_those_by_joins(study, monkeypatch, step):
    entries = p.durable(study.entries)
    by_joins = unit_rows(p.embeddings(entries, study.nodes, study.config, most_local=0))
    monkeypatch.setattr(p, "STEP", step)
    local = unit_rows(p.embeddings(entries, study.nodes, study.config))
    assert local.shape == by_joins.shape and np.abs(local @ local.T - by_joins @ by_joins.T).max() < 1e-5


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_subspace_of_a_small_matrix_is_its_svd(spread):
    rng = np.random.default_rng(0)
    dense = rng.random((30, 20)) < 0.3
    dense[np.arange(30), np.arange(30) % 20] = True
    node, pack = np.nonzero(dense)
    a = dense / np.sqrt(dense.sum(1, keepdims=True) * dense.sum(0))
    u, s, _ = np.linalg.svd(a)
    got = p.subspace(node.astype(np.int32), p.ranks(pack * spread + 10**12), rng.random((3, 30)), 300)
    want = u[:, :3] * s[:3]
    assert np.abs(got.T @ got - want @ want.T).max() < 1e-6


@pytest.fixture(scope="module")
def both_forms(study):
    rows = p.durable(p.training_sample(study.top, study.targets, study.config, study.parts))
    return rows, p.durable(p.ranking_features(rows, study.vectors, study.features, study.cluster_of, study.config))


def test_features_and_scores_in_place_equal_those_by_joins(study, both_forms):
    rows, joined = both_forms
    d = len(p.feature_names(4))
    rng = np.random.default_rng(1)
    model = p.Ranker(rng.random(d), rng.random(d), rng.random(d) - 0.5, 0.25)
    keys = ["pack_id", "node_id"]
    got = p.ranked_rows(rows, study.shared, model).orderBy(*keys).collect()
    want = joined.orderBy(*keys).collect()
    x = np.array([r.features for r in want], dtype=float)
    assert len(got) == len(want) > 1000 and [(r.pack_id, r.node_id, r.label) for r in got] == [(r.pack_id, r.node_id, r.label) for r in want]
    assert np.abs(x[:, 0] - [r.cosine for r in got]).max() < 1e-6
    assert np.abs(((x - model.mean) * model.factor) @ model.weights + 0.25 - [r.hybrid for r in got]).max() < 1e-5
    # A creator and a node that nothing is known of.
    odd = rows.limit(1).selectExpr("-5L AS creator_id", "-6L AS node_id", *[c for c in rows.columns if c not in ("creator_id", "node_id")])
    a = p.ranked_rows(odd, study.shared, model).first()
    b = np.array(p.ranking_features(odd, study.vectors, study.features, study.cluster_of, study.config).first().features, dtype=float)
    assert a.cosine == 0 and abs(((b - model.mean) * model.factor) @ model.weights + 0.25 - a.hybrid) < 1e-5


def test_newton_steps_reach_the_optimum_of_the_ranker(study, both_forms):
    rows, joined = both_forms
    model = p.fitted_ranker(rows, study.shared, study.config)
    x = np.array([r.features for r in joined.select("features").collect()], dtype=float)
    y = np.array([r.label for r in joined.select("label").collect()], dtype=float)
    weight = np.where(y == 1, min(20.0, (len(y) - y.sum()) / y.sum()), 1.0)
    spread = x.std(axis=0, ddof=1)
    z = np.where(spread > 1e-12, (x - x.mean(axis=0)) / np.where(spread > 1e-12, spread, 1), 0.0)

    def loss(beta, b):
        m = z @ beta + b
        return (weight * (np.logaddexp(0, m) - y * m)).sum() / weight.sum() + 1e-5 / 2 * (beta**2).sum()

    theirs = p.hybrid_ranker(joined, study.config).stages[1]
    best = loss(model.weights, model.intercept)
    assert best <= loss(theirs.coefficients.toArray(), theirs.intercept) + 1e-9
    rng = np.random.default_rng(0)
    assert all(best <= loss(model.weights + rng.normal(0, 0.01, len(model.weights)), model.intercept) for _ in range(20))
    assert len(p.coefficients(model, study.config)) == len(model.weights)
