"""What steps leave on disk."""

from collections import Counter

from pyspark.sql import functions as F

from hyperloom.operators import linkpred as p
from hyperloom.plans.linkpred_queries import Study
from hyperloom.sources.crosswalk import Tables
from hyperloom.storage import CLEANUP, durable


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffles_behind_a_written_table_are_removed(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = spark.range(10_000).repartition(7, "id").groupBy(F.col("id") % 100).agg(F.count("*").alias("n"))
    first, second = durable(rows), durable(rows)  # a plan whose files were removed can run again
    assert not shuffle_files(spark) - before
    assert first.agg(F.sum("n")).first()[0] == 10_000 and second.count() == 100
    assert spark.conf.get(CLEANUP) == setting


def test_coverage_counts_packs_without_expanding_them(spark):
    s = Study(Tables(spark, "/root/testdata/sf0.001"))
    want, positives = Counter(), Counter()
    for r in s.candidates.select("split", "label", "follows", "followed_by", "shared_packs", "from_cluster", "from_global").collect():
        for name, on in (("follows", r.follows), ("followed_by", r.followed_by), ("comember", r.shared_packs > 0), ("cluster", r.from_cluster), ("global", r.from_global)):
            want[r.split, name] += on
            positives[r.split, name] += on and r.label
    found = p.source_coverage(s.top, s.targets, s.parts)
    assert {(r.split, r.source): (r.candidates, r.positives) for r in found.collect()} == {k: (want[k], positives[k]) for k in want}
    assert p.source_coverage(s.top.where("false"), s.targets, s.parts).count() == 0
