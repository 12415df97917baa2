"""Cutting lineage by tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
#: Spark removes a query's shuffle files at its end if this is set, and otherwise when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="hyperloom-"))
    return _OWN_FOLDER[0]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it back.

    Unlike a local checkpoint this survives lost executors; unlike an RDD
    checkpoint the rows stay columnar, so later steps read only what they need.
    The shuffles behind them are of no use any more and are removed.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/hyperloom/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)
