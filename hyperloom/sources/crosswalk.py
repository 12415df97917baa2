"""The domain tables, derived from star-schema tables.

Nodes are parts, packs are orders, members are ordered parts, a follow goes from
the ordering customer to the part. The same derivation in DuckDB's dialect is
``PRELUDE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy domain tables over a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("node_id"),
            F.expr("CASE WHEN p_size % 11 = 0 THEN NULL ELSE date_add(DATE '1994-06-01', CAST(p_partkey * 37 % 900 AS INT)) END").alias("date_created"),
            F.expr("CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 3 = 0 THEN false ELSE true END").alias("active"),
            F.expr("CASE WHEN p_size % 3 = 0 THEN p_brand END").alias("status"),
        )

    @property
    def packs(self) -> DataFrame:
        sizes = self.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("member_count"))
        return (
            self.raw("orders")
            .join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("pack_id"),
                F.col("o_custkey").alias("creator_id"),
                F.to_date("o_orderdate").alias("date_created"),
                F.coalesce("member_count", F.lit(0)).alias("member_count"),
            )
        )

    @property
    def pack_heads(self) -> DataFrame:
        """Packs without their counts, so without a look at memberships."""
        return self.raw("orders").select(F.col("o_orderkey").alias("pack_id"), F.col("o_custkey").alias("creator_id"), F.to_date("o_orderdate").alias("date_created"))

    @property
    def memberships(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("member_id"), F.to_date("l_shipdate").alias("date_added"))

    @property
    def memberships_sparse(self) -> DataFrame:
        return self.raw("lineitem").where("l_quantity <= 2").select(F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("member_id"), F.to_date("l_shipdate").alias("date_added"))

    @property
    def unique_memberships(self) -> DataFrame:
        return self.memberships.select("pack_id", "member_id").distinct()

    @property
    def follows(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.to_date("l_shipdate").alias("date_followed")
        )

    @property
    def labels(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("node_id"), F.expr("p_partkey % 7").alias("community"))


#: The same tables for DuckDB, as the head of a WITH clause.
CTES = """
nodes AS (
  SELECT p_partkey AS node_id,
         CASE WHEN p_size % 11 = 0 THEN NULL ELSE DATE '1994-06-01' + CAST(p_partkey * 37 % 900 AS INTEGER) END AS date_created,
         CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 3 = 0 THEN false ELSE true END AS active,
         CASE WHEN p_size % 3 = 0 THEN p_brand END AS status
  FROM part
), packs AS (
  SELECT o_orderkey AS pack_id, o_custkey AS creator_id, CAST(o_orderdate AS DATE) AS date_created, count(l_orderkey) AS member_count
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
), memberships AS (
  SELECT l_orderkey AS pack_id, l_partkey AS member_id, CAST(l_shipdate AS DATE) AS date_added FROM lineitem
), memberships_sparse AS (
  SELECT l_orderkey AS pack_id, l_partkey AS member_id, CAST(l_shipdate AS DATE) AS date_added FROM lineitem WHERE l_quantity <= 2
), unique_memberships AS (
  SELECT DISTINCT l_orderkey AS pack_id, l_partkey AS member_id FROM lineitem
), follows AS (
  SELECT o_custkey AS src, l_partkey AS dst, CAST(l_shipdate AS DATE) AS date_followed FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), node_labels AS (
  SELECT p_partkey AS node_id, p_partkey % 7 AS community FROM part
)"""


def oracle(query: str, recursive: bool = False) -> str:
    """DuckDB SQL of ``query``, which may start with more CTEs as ``, name AS (...)``."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{CTES.strip()}{query if query.lstrip().startswith(',') else chr(10) + query}"
