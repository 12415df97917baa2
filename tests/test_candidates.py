"""Candidates by creator: what moves, and checks that find what is wrong."""

import re

from pyspark.sql import functions as F

from hyperloom.operators import linkpred as p
from hyperloom.plans.linkpred_queries import Study
from hyperloom.sources.crosswalk import Tables


def exchanges(df):
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_candidates_are_dealt_out_once_and_checks_find_faults(spark):
    s = Study(Tables(spark, "/root/testdata/sf0.001"))
    # Packs and labels come to the candidates, which stay where they are.
    assert exchanges(s.candidates) - exchanges(s.top) == 1
    cands = s.candidates.where("creator_id % 20 = 0").localCheckpoint()
    row = cands.where("label = 0").limit(1)
    wrong = [row.withColumn("label", F.lit(1)), row, row.withColumn("node_id", F.col("creator_id")), cands.where("label = 1").limit(1).withColumn("label", F.lit(0))]
    for extra, name in zip(wrong, ["labels_without_target", "duplicate_candidates", "creator_as_candidate", "targets_with_label_0"], strict=True):
        out = p.leakage_checks(cands.unionByName(extra), s.history, s.t.memberships, s.splits, s.targets, s.config, s.parts)
        assert {r.check: r.violations for r in out.collect()}[name] == 1, name
