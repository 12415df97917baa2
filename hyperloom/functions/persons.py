"""Person-level lookups as SQL functions over a view of follows (src, dst, date_followed)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import write_adjacency
from ..storage import shared_folder

NAMES = ["follows_of", "followers_of", "is_following", "mutual_follows_of", "common_follows_of"]


def register(spark: SparkSession, view: str = "follows", by_dst: str | None = None, suffix: str = "") -> None:
    """Create the five functions as temporary SQL functions over ``view``, and over ``by_dst`` for
    lookups by target; ``suffix`` ends their names."""
    out, into, follows_it, mutual, common = (f"{n}{suffix}" for n in NAMES)
    rows, back = "RETURNS TABLE (node_id BIGINT, date_followed DATE)", by_dst or view
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {out}(person BIGINT) {rows} RETURN SELECT dst, date_followed FROM {view} WHERE src = {out}.person")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {into}(person BIGINT) {rows} RETURN SELECT src, date_followed FROM {back} WHERE dst = {into}.person")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {follows_it}(a BIGINT, b BIGINT) RETURNS BOOLEAN RETURN SELECT count(*) > 0 FROM {view} WHERE src = {follows_it}.a AND dst = {follows_it}.b")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {mutual}(person BIGINT) RETURNS TABLE (node_id BIGINT, followed DATE, followed_by DATE) "
        f"RETURN SELECT o.node_id, o.date_followed, i.date_followed FROM {out}({mutual}.person) o JOIN {into}({mutual}.person) i ON o.node_id = i.node_id"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {common}(a BIGINT, b BIGINT) RETURNS TABLE (node_id BIGINT, followed_by_a DATE, followed_by_b DATE) "
        f"RETURN SELECT x.node_id, x.date_followed, y.date_followed FROM {out}({common}.a) x JOIN {out}({common}.b) y ON x.node_id = y.node_id"
    )


def _run(spark: SparkSession, query: str, view: str, by_dst: str | None, suffix: str) -> DataFrame:
    register(spark, view, by_dst, suffix)
    return spark.sql(re.sub(rf"\b({'|'.join(NAMES)})\b", rf"\1{suffix}", query))


def call(spark: SparkSession, follows: DataFrame, query: str) -> DataFrame:
    """Run ``query`` with the functions over ``follows``, under names of their own."""
    suffix = f"_{uuid.uuid4().hex}"
    follows.createOrReplaceTempView(f"follows{suffix}")
    return _run(spark, query, f"follows{suffix}", None, suffix)


class Adjacency:
    """Follows in two bucketed and sorted tables, by source and by target: a lookup reads one bucket."""

    def __init__(self, follows: DataFrame, buckets: int = 256):
        self.spark, self.suffix = follows.sparkSession, f"_{uuid.uuid4().hex}"
        self.by_src, self.by_dst = (f"follows_{key}{self.suffix}" for key in ("src", "dst"))
        for table, key in ((self.by_src, "src"), (self.by_dst, "dst")):
            write_adjacency(follows, table, key, buckets, f"{shared_folder(self.spark)}/hyperloom/{table}")

    def query(self, query: str) -> DataFrame:
        """Run ``query`` with the functions over the two tables."""
        return _run(self.spark, query, self.by_src, self.by_dst, self.suffix)

    def drop(self) -> None:
        for table in (self.by_src, self.by_dst):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
