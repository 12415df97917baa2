"""Statistics of the directed temporal follow graph and of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_creation_volume(nodes: DataFrame) -> DataFrame:
    return nodes.where("date_created IS NOT NULL").groupBy("date_created").agg(F.count("*").alias("account_count"))


def node_status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("active", "status").agg(F.count("*").alias("account_count"))


def node_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("total"),
        F.count_if("active").alias("active"),
        F.count_if(F.col("active") | F.col("active").isNull()).alias("extant"),
        F.count_if(F.col("active").isNull()).alias("unknown"),
    )


def status_rollup(nodes: DataFrame) -> DataFrame:
    """Counts for a status plot: Active, Inactive, Unknown."""
    label = F.when(F.col("active").isNull(), "Unknown").when(F.col("active"), "Active").otherwise("Inactive")
    return nodes.groupBy(label.alias("label")).agg(F.count("*").alias("account_count"))


def sample_follows(follows: DataFrame, row_limit: int) -> DataFrame:
    """The first rows in a fixed order, so that a sample can be repeated."""
    if row_limit < 1:
        raise ValueError("row_limit must be at least 1")
    return follows.orderBy("src", "dst", "date_followed").limit(row_limit)


def follow_volume(follows: DataFrame) -> DataFrame:
    """Follows per day; the group without a date stays."""
    return follows.groupBy("date_followed").agg(F.count("*").alias("follow_count"))


def _ends(follows: DataFrame, *more: str) -> DataFrame:
    """Each edge as two rows (node_id, incoming): one shuffle serves both directions."""
    ends = F.inline(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("incoming")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("incoming"))))
    return follows.select(ends, *more)


def follow_degrees(follows: DataFrame) -> DataFrame:
    """In- and out-degree of every node that touches an edge; parallel edges and loops count."""
    return _ends(follows).groupBy("node_id").agg(F.sum("incoming").alias("in_degree"), F.sum(1 - F.col("incoming")).alias("out_degree"))


def follow_degree_distribution(degrees: DataFrame) -> DataFrame:
    sides = F.inline(F.array(F.struct(F.col("in_degree").alias("degree"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("out_degree").alias("degree"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return degrees.select(sides).where("degree > 0").groupBy("degree").agg(F.sum("i").alias("in_node_count"), F.sum("o").alias("out_node_count"))


def follow_time_std(follows: DataFrame) -> DataFrame:
    """Sample standard deviation, in days, of the dates of incoming and outgoing edges."""
    day = F.when(F.col("date_followed").isNotNull(), F.unix_date("date_followed"))
    rows = _ends(follows.withColumn("day", day), "day")
    side = lambda k: F.stddev_samp(F.when(F.col("incoming") == k, F.col("day")).cast("double"))
    return rows.groupBy("node_id").agg(side(1).alias("in_std_days"), side(0).alias("out_std_days"))


def impossible_timestamps(follows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges dated before the creation of either end; unknown dates don't count."""
    made = nodes.select("node_id", "date_created")
    src, dst = (made.select(F.col("node_id").alias(k), F.col("date_created").alias(f"{k}_created")) for k in ("src", "dst"))
    early = "date_followed < src_created OR date_followed < dst_created"
    return follows.join(src, "src", "left").join(dst, "dst", "left").where(early).agg(F.count("*").alias("impossible"))


def follow_summary(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.sum("out_degree").alias("edges"), F.count("*").alias("nodes"), F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"))


def degree_counts(follows: DataFrame, person: int) -> DataFrame:
    near = follows.where((F.col("src") == person) | (F.col("dst") == person))
    return near.agg(F.count_if(F.col("src") == person).alias("following"), F.count_if(F.col("dst") == person).alias("followers"))


def recent_follows(follows: DataFrame, person: int, incoming: bool = False, limit: int = 20) -> DataFrame:
    own, other = ("dst", "src") if incoming else ("src", "dst")
    rows = follows.where(F.col(own) == person).select(F.col(other).alias("node_id"), "date_followed")
    return rows.orderBy(F.col("date_followed").desc_nulls_last(), "node_id").limit(limit)


def person_card(nodes: DataFrame, degrees: DataFrame, person: int) -> DataFrame:
    card = nodes.where(F.col("node_id") == person).join(degrees.where(F.col("node_id") == person), "node_id", "left")
    return card.select("node_id", "date_created", "active", "status", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def with_profiles(people: DataFrame, nodes: DataFrame) -> DataFrame:
    return people.join(nodes, "node_id", "left").select("node_id", "date_followed", "date_created", "active", "status")


def monthly_activity(follows: DataFrame, person: int) -> DataFrame:
    return follows.where(F.col("src") == person).groupBy(F.trunc("date_followed", "month").alias("month")).agg(F.count("*").alias("follows"))


def top_nodes(degrees: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return degrees.orderBy(F.desc(column), "node_id").limit(limit).select("node_id", column)


def busiest_days(volume: DataFrame, limit: int = 20) -> DataFrame:
    return volume.orderBy(F.desc("follow_count"), "date_followed").limit(limit)


def check_endpoints(follows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``follows``; an error if an end is beyond the greatest node."""
    last = nodes.agg(F.max("node_id")).first()[0]
    most = follows.agg(F.max(F.greatest("src", "dst"))).first()[0]
    if most is not None and (last is None or most > last):
        raise ValueError(f"a follow ends at {most}, the last node is {last}")
    return follows
