"""Registered queries of the time-split prediction, with DuckDB SQL.

Where clusters enter a query with SQL they are node_id % 8, so that both engines
have the same; the learned ones are registered beside them without SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import linkpred as p
from ..sources.crosswalk import Tables

CONFIG = p.Config(clusters=16)
MODELS = ["popularity", "heuristic"]


class Study:
    def __init__(self, t: Tables, config: p.Config = CONFIG, learned: bool = False):
        self.t, self.config, self.learned = t, config, learned

    @cached_property
    def splits(self):
        return p.pack_splits(self.t.pack_heads, self.config)

    @cached_property
    def history(self):
        return p.durable(p.history_memberships(self.t.memberships, self.splits, self.config))

    @cached_property
    def nodes(self):
        return p.durable(p.history_nodes(self.history))

    @cached_property
    def packs(self):
        return p.history_packs(self.history)

    @cached_property
    def entries(self):
        return p.incidence(self.history, self.nodes, self.packs)

    @cached_property
    def targets(self):
        return p.durable(p.target_memberships(self.t.memberships, self.splits, self.nodes))

    @cached_property
    def totals(self):
        return p.durable(p.target_totals(self.targets))

    @cached_property
    def creators(self):
        return p.durable(p.target_creators(self.totals))

    @cached_property
    def parts(self):
        return p.parts_of(self.creators)

    @cached_property
    def features(self):
        return p.durable(p.node_features(self.nodes, p.history_degrees(self.t.follows, self.config)))

    @cached_property
    def follow(self):
        return p.follow_candidates(self.t.follows, self.creators, self.nodes, self.config)

    @cached_property
    def comember(self):
        return p.comember_candidates(self.history, self.creators, self.config)

    @cached_property
    def popular(self):
        return p.global_popular(self.features, self.config)

    @cached_property
    def vectors(self):
        return p.durable(p.embeddings(p.durable(self.entries), self.nodes, self.config))

    @cached_property
    def cluster_of(self):
        if self.learned:
            return p.durable(p.clusters(self.vectors, self.config))
        return self.nodes.select("node_id", F.expr("node_id % 8").alias("cluster"))

    @cached_property
    def cluster_top(self):
        return p.cluster_popular(self.features, self.cluster_of, self.config)

    @cached_property
    def pool(self):
        return p.candidate_pool(self.totals, self.follow, self.comember, self.cluster_top, self.cluster_of, self.popular, self.config)

    def top_of(self, creators):
        return p.creator_candidates(self.t.follows, self.history, creators, self.nodes, self.features, self.cluster_top, self.cluster_of, self.popular, self.config, self.parts)

    @cached_property
    def top(self):
        return self.top_of(self.creators)

    @cached_property
    def candidates(self):
        """Not written: every pack repeats its creator's candidates."""
        return p.expanded(self.top, self.targets, self.parts)

    @cached_property
    def shared(self):
        """The nodes' vectors and counts at every worker, or None: too many."""
        found = p.lookup(self.vectors, self.features, self.cluster_of, self.config)
        return None if found is None else self.t.spark.sparkContext.broadcast(found)

    def split_creators(self, condition: str):
        """Creators with target packs of some splits: others' candidates are not made."""
        return p.durable(p.target_creators(self.totals.where(condition)))

    @cached_property
    def ranker(self):
        rows = p.training_sample(self.top_of(self.split_creators("split = 'train'")), self.targets, self.config, self.parts)
        if self.shared is not None:
            return p.fitted_ranker(rows, self.shared, self.config)
        return p.hybrid_ranker(p.ranking_features(rows, self.vectors, self.features, self.cluster_of, self.config), self.config)

    @cached_property
    def scored(self):
        """The candidates of each creator outside the training split, which all its packs have, with every score."""
        top = self.top_of(self.split_creators("split <> 'train'"))
        if self.shared is not None:
            return p.with_baselines(p.ranked_rows(top, self.shared, self.ranker))
        rows = p.ranking_features(top, self.vectors, self.features, self.cluster_of, self.config)
        return p.with_baselines(p.hybrid_scores(self.ranker, rows).drop("features"))


def KEY(node: str) -> str:
    return f"(({node} * 2654435761 + {CONFIG.seed * 40503}) % 4294967296)"


_c = CONFIG
SPLITS = f""", sp AS (SELECT pack_id, creator_id, date_created, CASE WHEN date_created <= DATE '{_c.history_end}' THEN 'history' WHEN date_created BETWEEN DATE '{_c.train[0]}' AND DATE '{_c.train[1]}' THEN 'train'
  WHEN date_created BETWEEN DATE '{_c.validation[0]}' AND DATE '{_c.validation[1]}' THEN 'validation' WHEN date_created BETWEEN DATE '{_c.test[0]}' AND DATE '{_c.test[1]}' THEN 'test' ELSE 'excluded' END AS split FROM packs)"""
HISTORY = SPLITS + f", hm AS (SELECT DISTINCT pack_id, member_id AS node_id FROM memberships JOIN sp USING (pack_id) WHERE split = 'history' AND date_added <= DATE '{_c.history_end}')"
NODES = HISTORY + ", hn AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_index, count(*) AS packs FROM hm GROUP BY node_id)"
HPACKS = NODES + ", hp AS (SELECT pack_id, row_number() OVER (ORDER BY pack_id) - 1 AS pack_index, count(*) AS size FROM hm GROUP BY pack_id)"
TARGETS = NODES + """, tm AS (SELECT DISTINCT pack_id, split, creator_id, member_id AS node_id, member_id IN (SELECT node_id FROM hn) AS history_eligible FROM memberships JOIN sp USING (pack_id)
  WHERE split IN ('train', 'validation', 'test') AND date_added <= date_created AND member_id <> creator_id)"""
TOTALS = TARGETS + ", tt AS (SELECT pack_id, split, creator_id, count(*) AS members, count(*) FILTER (history_eligible) AS eligible_members FROM tm GROUP BY 1, 2, 3), tc AS (SELECT DISTINCT creator_id FROM tt)"
FEATURES = TOTALS + f""", hf AS (SELECT * FROM follows WHERE date_followed <= DATE '{_c.history_end}'),
nf AS (SELECT node_id, node_index, packs, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM hn LEFT JOIN (SELECT dst AS node_id, count(*) AS i FROM hf GROUP BY 1) USING (node_id) LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM hf GROUP BY 1) USING (node_id))"""
FOLLOW = FEATURES + f""", fr AS (SELECT creator_id, node_id, bool_or(o) AS follows, bool_or(NOT o) AS followed_by FROM (SELECT src AS creator_id, dst AS node_id, true AS o FROM hf UNION ALL SELECT dst, src, false FROM hf)
  JOIN tc USING (creator_id) JOIN hn USING (node_id) WHERE creator_id <> node_id GROUP BY 1, 2),
fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY follows::INT + followed_by::INT DESC, {KEY("node_id")}, node_id) AS rank FROM fr) WHERE rank <= {_c.follow_cap})"""
COMEMBER = FOLLOW + f""", cr AS (SELECT x.node_id AS creator_id, y.node_id, count(*) AS shared_packs FROM hm x JOIN tc ON tc.creator_id = x.node_id JOIN hm y ON x.pack_id = y.pack_id AND x.node_id <> y.node_id GROUP BY 1, 2),
cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY shared_packs DESC, {KEY("node_id")}, node_id) AS rank FROM cr) WHERE rank <= {_c.comember_cap})"""
POPULAR = COMEMBER + f", gp AS (SELECT node_id, packs, in_degree, row_number() OVER (ORDER BY packs DESC, in_degree DESC, {KEY('node_id')}, node_id) AS rank FROM nf ORDER BY rank LIMIT {max(_c.global_pool, _c.global_cap)})"
CLUSTER = POPULAR + f", ct AS (SELECT * FROM (SELECT node_id % 8 AS cluster, node_id, row_number() OVER (PARTITION BY node_id % 8 ORDER BY packs DESC, in_degree DESC, node_id) AS rank FROM nf) WHERE rank <= {_c.cluster_cap})"
POOL = CLUSTER + f""", pl AS (SELECT creator_id, node_id, bool_or(a) AS follows, bool_or(b) AS followed_by, max(s) AS shared_packs, bool_or(k) AS from_cluster, bool_or(g) AS from_global FROM (
  SELECT creator_id, node_id, follows AS a, followed_by AS b, 0 AS s, false AS k, false AS g FROM fc UNION ALL SELECT creator_id, node_id, false, false, shared_packs, false, false FROM cc
  UNION ALL SELECT creator_id, ct.node_id, false, false, 0, true, false FROM tc JOIN hn ON hn.node_id = creator_id JOIN ct ON ct.cluster = creator_id % 8
  UNION ALL SELECT creator_id, node_id, false, false, 0, false, true FROM tc, gp WHERE rank <= {_c.global_cap}) WHERE creator_id <> node_id GROUP BY 1, 2)"""
CAND = POOL + f""", sc AS (SELECT pl.*, packs, in_degree, out_degree, 4 * follows::INT + 4 * followed_by::INT + 3 * least(shared_packs, 10) + 2 * from_cluster::INT + ln(1 + packs::DOUBLE) AS retrieval_score FROM pl JOIN nf USING (node_id)),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY round(retrieval_score, 9) DESC, node_id) AS candidate_rank FROM sc) WHERE candidate_rank <= {_c.most_candidates}),
cd AS (SELECT tt.pack_id, split, tp.*, EXISTS (SELECT 1 FROM tm WHERE tm.pack_id = tt.pack_id AND tm.node_id = tp.node_id)::INT AS label FROM tt JOIN tp USING (creator_id))"""
SCORED = CAND + ", lg AS (" + " UNION ALL ".join(
    f"SELECT pack_id, node_id, label, '{m}' AS model, round({e}, 9) AS score FROM cd"
    for m, e in (("popularity", "ln(1 + packs::DOUBLE) + 0.25 * ln(1 + in_degree::DOUBLE) + 0.1 * ln(1 + out_degree::DOUBLE)"), ("heuristic", "retrieval_score"))
) + """), rk AS (SELECT *, row_number() OVER (PARTITION BY model, pack_id ORDER BY score DESC, node_id) AS rank FROM lg),
ht AS (SELECT model, pack_id, min(rank) AS first, count(*) AS found, """ + ", ".join(f"count(*) FILTER (rank <= {k}) AS n_{k}" for k in _c.ks) + """ FROM rk WHERE label = 1 GROUP BY 1, 2),
pp AS (SELECT split, model, pack_id, members AS positive_members, coalesce(1 / first, 0) AS mrr, coalesce(found, 0) / members AS candidate_recall, """ + ", ".join(f"coalesce(n_{k}, 0) AS f_{k}" for k in _c.ks) + """
  FROM tt CROSS JOIN (SELECT unnest(['popularity', 'heuristic']) AS model) LEFT JOIN ht USING (model, pack_id))"""


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _s(step, learned: bool = False):
    return lambda t: step(Study(t, learned=learned))


def _metrics(df):
    return _r(df, *[x for x in df.columns if x not in ("split", "model", "packs")])


def _per_pack(s: Study):
    return p.creator_metrics(p.with_baselines(s.top), s.targets, s.totals, MODELS, _c.ks, s.parts)


def _hybrid_metrics(s: Study):
    targets, totals = (x.where("split <> 'train'") for x in (s.targets, s.totals))
    return p.ranking_metrics(p.creator_metrics(s.scored, targets, totals, [*MODELS, "cosine", "hybrid"], _c.ks, s.parts), _c.ks)


def _coefficients(s: Study):
    return s.t.spark.createDataFrame(p.coefficients(s.ranker, s.config), "feature string, standardized_coefficient double, odds_ratio_per_sd double")


DEFS: dict[str, tuple] = {
    "pack_splits": (_s(lambda s: s.splits), SPLITS + " SELECT * FROM sp"),
    "history_memberships": (_s(lambda s: s.history), HISTORY + " SELECT * FROM hm"),
    "history_nodes": (_s(lambda s: s.nodes), NODES + " SELECT * FROM hn"),
    "history_packs": (_s(lambda s: s.packs), HPACKS + " SELECT * FROM hp"),
    "incidence": (_s(lambda s: _r(s.entries, "value", digits=9)), HPACKS + " SELECT node_index, pack_index, round(1 / sqrt(packs * size), 9) AS value FROM hm JOIN hn USING (node_id) JOIN hp USING (pack_id)"),
    "target_memberships": (_s(lambda s: s.targets), TARGETS + " SELECT * FROM tm"),
    "target_pack_totals": (_s(lambda s: s.totals), TOTALS + " SELECT * FROM tt"),
    "target_creators": (_s(lambda s: s.creators), TOTALS + " SELECT * FROM tc"),
    "split_summary": (
        _s(lambda s: _r(p.split_summary(s.splits, s.totals), "eligible_share")),
        TOTALS + """ SELECT CASE split WHEN 'history' THEN 0 WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 3 ELSE 4 END AS split_order, split, packs, target_packs, members, eligible_members, median_members, round(eligible_members / nullif(members, 0), 6) AS eligible_share
        FROM (SELECT split, count(*) AS packs FROM sp GROUP BY 1) LEFT JOIN (SELECT split, count(*) AS target_packs, sum(members)::BIGINT AS members, sum(eligible_members)::BIGINT AS eligible_members, median(members) AS median_members FROM tt GROUP BY 1) USING (split)""",
    ),
    "history_node_features": (_s(lambda s: s.features), FEATURES + " SELECT * FROM nf"),
    "follow_candidates": (_s(lambda s: s.follow), FOLLOW + " SELECT * FROM fc"),
    "comember_candidates": (_s(lambda s: s.comember), COMEMBER + " SELECT * FROM cc"),
    "global_popular": (_s(lambda s: s.popular), POPULAR + " SELECT * FROM gp"),
    "cluster_popular": (_s(lambda s: s.cluster_top), CLUSTER + " SELECT * FROM ct"),
    "candidate_pool": (_s(lambda s: s.pool), POOL + " SELECT * FROM pl"),
    "prediction_candidates": (_s(lambda s: _r(s.candidates, "retrieval_score")), CAND + " SELECT * REPLACE (round(retrieval_score, 6) AS retrieval_score) FROM cd"),
    "candidate_summary": (
        _s(lambda s: _r(p.candidate_summary(s.candidates, s.totals), "mean_candidates", "recall")),
        CAND + """ SELECT split, packs, members, candidates, packs_with_candidates, positives, round(candidates / packs, 6) AS mean_candidates, round(positives / members, 6) AS recall
        FROM (SELECT split, count(*) AS packs, sum(members)::BIGINT AS members FROM tt GROUP BY 1) LEFT JOIN (SELECT split, count(*) AS candidates, count(DISTINCT pack_id) AS packs_with_candidates, sum(label)::BIGINT AS positives FROM cd GROUP BY 1) USING (split)""",
    ),
    "training_sample": (
        _s(lambda s: _r(p.training_sample(s.top, s.targets, _c, s.parts), "retrieval_score")),
        CAND + f" SELECT * EXCLUDE (n) REPLACE (round(retrieval_score, 6) AS retrieval_score) FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, label ORDER BY {KEY('node_id')}, node_id) AS n FROM cd WHERE split = 'train') WHERE label = 1 OR n <= {_c.negatives}",
    ),
    "baseline_scores": (
        _s(lambda s: _r(p.with_baselines(s.candidates).select("pack_id", "node_id", *MODELS), *MODELS)),
        CAND + " SELECT pack_id, node_id, round(ln(1 + packs::DOUBLE) + 0.25 * ln(1 + in_degree::DOUBLE) + 0.1 * ln(1 + out_degree::DOUBLE), 6) AS popularity, round(retrieval_score, 6) AS heuristic FROM cd",
    ),
    "per_pack_metrics": (
        _s(lambda s: _r(_per_pack(s).select("split", "model", "pack_id", "positive_members", "mrr", "candidate_recall"), "mrr", "candidate_recall")),
        SCORED + " SELECT split, model, pack_id, positive_members, round(mrr, 6) AS mrr, round(candidate_recall, 6) AS candidate_recall FROM pp",
    ),
    "ranking_metrics": (
        _s(lambda s: _metrics(p.ranking_metrics(_per_pack(s), _c.ks))),
        SCORED + " SELECT split, model, count(*) AS packs, round(avg(mrr), 6) AS mrr, round(avg(candidate_recall), 6) AS candidate_recall, "
        + ", ".join(f"round(avg((f_{k} > 0)::INT), 6) AS hit_at_{k}, round(avg(f_{k} / positive_members), 6) AS macro_recall_at_{k}, round(sum(f_{k}) / sum(positive_members), 6) AS micro_recall_at_{k}" for k in _c.ks)
        + " FROM pp GROUP BY 1, 2",
    ),
    "recommendations": (
        _s(lambda s: _r(p.recommendations(s.top, s.targets, "retrieval_score", s.parts), "score")),
        CAND + " SELECT pack_id, creator_id, rank, node_id AS candidate_id, round(retrieval_score, 6) AS score, label FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY round(retrieval_score, 9) DESC, node_id) AS rank FROM cd WHERE split = 'test') WHERE rank <= 100",
    ),
    "source_coverage": (
        _s(lambda s: p.source_coverage(s.top, s.targets, s.parts)),
        CAND + " SELECT split, source, count(*) FILTER (hit) AS candidates, count(*) FILTER (hit AND label = 1) AS positives FROM (" + " UNION ALL ".join(
            f"SELECT split, label, '{n}' AS source, {e} AS hit FROM cd" for n, e in (("follows", "follows"), ("followed_by", "followed_by"), ("comember", "shared_packs > 0"), ("cluster", "from_cluster"), ("global", "from_global"))
        ) + ") GROUP BY 1, 2",
    ),
    "leakage_checks": (
        _s(lambda s: p.leakage_checks(s.candidates, s.history, s.t.memberships, s.splits, s.targets, _c, s.parts)),
        " SELECT unnest(['history_rows_before_end', 'history_packs_before_end', 'candidates_over_cap', 'duplicate_candidates', 'creator_as_candidate', 'labels_without_target', 'targets_with_label_0']) AS \"check\", 0::BIGINT AS violations",
    ),
    "embeddings": (_s(lambda s: s.vectors), None),
    "clusters": (_s(lambda s: s.cluster_of, True), None),
    "hybrid_ranker": (_s(_coefficients, True), None),
    "hybrid_metrics": (_s(lambda s: _metrics(_hybrid_metrics(s)), True), None),
}
