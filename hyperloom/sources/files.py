"""Readers of the raw formats, sample validation, inventory, session report and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known datasets and their canonical file names.
DATASETS = {
    "nodes_csv": "nodes.csv.gz",
    "nodes_jsonl": "nodes.json.gz",
    "packs_jsonl": "packs.json.gz",
    "pack_edgelist": "packs.txt.gz",
    "follows_csv": "follows.csv.gz",
    "follows_parquet": "follows.parquet",
}


def _files(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of a folder on any file system that Spark can list."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getPath().toString(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(path)] if fs.exists(path) else []


def resolve(spark: SparkSession, folder: str, dataset: str) -> str | None:
    """The path of a dataset; marks of repeated downloads such as ``x (1).csv`` are ignored."""
    plain = lambda name: re.sub(r"\s*\(\d+\)", "", name)
    found = sorted((name != DATASETS[dataset], path) for name, path, _ in _files(spark, folder) if plain(name) == DATASETS[dataset])
    return found[0][1] if found else None


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, path, bytes); absent datasets have no path."""
    size = {path: n for _, path, n in _files(spark, folder)}
    rows = [(d, p, size.get(p)) for d in DATASETS for p in [resolve(spark, folder, d)]]
    return spark.createDataFrame(rows, "dataset string, path string, bytes long")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("`id` long, `date-created` date, `active` boolean, `status` string").csv(path, header=True, nullValue="")
    return raw.select(F.col("id").alias("node_id"), F.col("`date-created`").alias("date_created"), "active", "status")


PACK = "`pack-id` long, `creator-id` long, `date-created` date, members array<struct<`id`: long, `date-added`: date>>"


def read_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packs, memberships); sizes are raw list lengths, repeated members stay."""
    raw = spark.read.schema(PACK).json(path)
    packs = raw.select(F.col("`pack-id`").alias("pack_id"), F.col("`creator-id`").alias("creator_id"), F.col("`date-created`").alias("date_created"), F.coalesce(F.size("members"), F.lit(0)).cast("long").alias("member_count"))
    rows = raw.select(F.col("`pack-id`").alias("pack_id"), F.explode("members").alias("m"))
    return packs, rows.select("pack_id", F.col("m.id").alias("member_id"), F.col("m.`date-added`").alias("date_added"))


def read_follows(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    if csv:
        return spark.read.schema("src long, dst long, date_followed date").csv(path)
    return spark.read.parquet(path).select(F.col("`from`").cast("long").alias("src"), F.col("`to`").cast("long").alias("dst"), F.col("date_followed").cast("date").alias("date_followed"))


def read_edgelist(spark: SparkSession, path: str) -> DataFrame:
    """One comma-joined member list per line -> (line, member_id)."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.explode(F.split("value", ",")).alias("m"))
    return rows.select("line", F.col("m").cast("long").alias("member_id"))


def read_value_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of numbers, one per line, as (value, count): imported distributions."""
    return spark.read.schema("value long").csv(path).groupBy("value").agg(F.count("*").alias("count"))


def read_s_line(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s long, nodes long, edges long").csv(path, header=True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of node id -> community as rows."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, long>")).alias("node_id", "community"))
    return text.select(F.col("node_id").cast("long").alias("node_id"), "community")


def _date_ok(c):
    return c.isNull() | (c == "") | c.try_cast("date").isNotNull()


def validate(spark: SparkSession, folder: str, sample_size: int = 100) -> DataFrame:
    """(dataset, ok, detail) over the first lines of every dataset that is there."""
    rows = []
    for name in DATASETS:
        path = resolve(spark, folder, name)
        if path is None:
            rows.append((name, False, "missing"))
            continue
        if name == "follows_parquet":
            have = set(spark.read.parquet(path).columns)
            lack = {"from", "to", "date_followed"} - have
            rows.append((name, not lack, f"missing columns: {sorted(lack)}" if lack else "columns"))
            continue
        lines = spark.read.text(path).limit(sample_size)
        n = lines.count()
        if name == "nodes_csv":
            raw = spark.read.csv(path, header=True).limit(sample_size)
            want = ["id", "date-created", "active", "status"]
            bad = None if raw.columns != want else raw.where(~(F.col("id").rlike(r"^\d+$") & _date_ok(F.col("`date-created`")) & (F.col("active").isNull() | F.lower("active").isin("true", "false")))).count()
        elif name == "follows_csv":
            raw = spark.read.csv(path).limit(sample_size)
            bad = None if len(raw.columns) != 3 else raw.where(~(F.col("_c0").rlike(r"^\d+$") & F.col("_c1").rlike(r"^\d+$") & _date_ok(F.col("_c2")))).count()
        elif name == "pack_edgelist":
            bad = lines.where(~F.col("value").rlike(r"^\d+(,\d+)*$")).count()
        else:
            keys = ["id"] if name == "nodes_jsonl" else ["pack-id", "creator-id", "date-created", "members"]
            parsed = [F.get_json_object("value", f"$['{k}']").isNull() for k in keys]
            bad = lines.where(parsed[0] if len(parsed) == 1 else parsed[0] | parsed[1] | parsed[2] | parsed[3]).count()
        rows.append((name, bad == 0, "wrong columns" if bad is None else f"{n} lines, {bad} bad"))
    return spark.createDataFrame(rows, "dataset string, ok boolean, detail string")


def doctor(spark: SparkSession) -> DataFrame:
    """(setting, value): version and the settings that matter for these operators."""
    keys = ["spark.master", "spark.driver.memory", "spark.executor.memory", "spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold"]
    conf = dict(spark.sparkContext.getConf().getAll())
    rows = [("version", spark.version), *[(k, conf.get(k) or spark.conf.get(k, None)) for k in keys]]
    return spark.createDataFrame(rows, "setting string, value string")


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Zstandard Parquet, optionally by partition columns."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_adjacency(follows: DataFrame, table: str, key: str = "src", buckets: int = 256, path: str | None = None) -> None:
    """A bucketed, sorted table: point lookups by ``key`` read one bucket, joins on it don't shuffle."""
    if not 16 <= buckets <= 1024:
        raise ValueError("buckets must be in 16..1024")
    other = "dst" if key == "src" else "src"
    # Rows of a bucket meet before they are written: one file a bucket.
    writer = follows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, other)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_summary(spark: SparkSession, path: str, task: str, seconds: float, summary: dict) -> None:
    """A JSON line with a task's time and numbers."""
    row = spark.createDataFrame([(json.dumps({"task": task, "seconds": seconds, "summary": summary}, default=str),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def compare_distributions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side: a symmetric difference."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
