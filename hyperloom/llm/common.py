"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable

__all__ = ["NOT_SPACE", "SPACE", "durable", "fresh", "running_sums", "slices", "table", "words"]

#: Java/RE2 class of the white space that separates words: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def running_sums(steps: Column, first: Column, part: int = 2048) -> Column:
    """first, first + steps[0], ... as array<long>. The sums are gathered as text, in parts of
    about ``part`` bytes, since appending copies: an array by element, a text at once."""
    full = lambda a: F.octet_length(a["part"]) >= part
    step = lambda a, x: F.struct(
        F.when(full(a), F.concat(a["done"], a["part"])).otherwise(a["done"]).alias("done"),
        F.concat(F.when(full(a), "").otherwise(a["part"]), F.lit(","), (a["sum"] + x).cast("string")).alias("part"),
        (a["sum"] + x).alias("sum"),
    )
    start = F.struct(F.lit("").alias("done"), first.cast("string").alias("part"), first.alias("sum"))
    return F.split(F.aggregate(steps, start, step, lambda a: F.concat(a["done"], a["part"])), ",").cast("array<bigint>")


def slices(batches, rows: int = 512):
    """Arrow batches in parts of few rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
