"""Mixing sources to target weights by Poisson replication.

A source with n documents and a target share w of T output documents has the
repetition rate w * T / n. Each document gets a uniform number from the hash of
seed and id, the inverted Poisson distribution with that rate turns it into a
count, and the document is exploded by its count. Expected counts meet the
targets exactly, every document decides alone, and reruns or lost executors
repeat the same decisions. A second hash per copy gives the global order.

Defined cases: null sources form one source; a null id draws from its text;
rows with equal ids get equal counts; a null text travels as it is; an empty
table gives no rows; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

SEED = 20
#: Sources up to this many travel as one small broadcast table, more are joined by shuffle.
MOST_BROADCAST_SOURCES = 10_000
#: Weights go with the source's share to this power: 1 leaves the mix, 0 evens it out.
ALPHA = 0.5


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source="source", alpha: float = ALPHA, total: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Rows (mix_source, n_docs, rate). ``weights`` (source, weight) replaces the power rule;
    ``total`` is the expected number of output rows, by default that of the input."""
    n = docs.groupBy(F.col(f"`{source}`").cast("string").alias("mix_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        w = weights.select(F.col("source").cast("string").alias("w_source"), F.col("weight").cast("double"))
        n = n.join(w, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna({"weight": 0.0})
    sums = n.agg(F.sum("weight").alias("w_sum"), F.sum("n_docs").alias("d_sum"))
    goal = F.lit(float(total)) if total is not None else F.col("d_sum").cast("double")
    rate = F.coalesce(F.col("weight") * goal / F.nullif(F.col("w_sum"), F.lit(0.0)) / F.col("n_docs"), F.lit(0.0))
    return n.crossJoin(F.broadcast(sums)).select("mix_source", "n_docs", rate.alias("rate"))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) > u. Terms run over rate +- 12 deviations (and 40), beyond which less than 1e-16 lies."""
    reach = 12 * F.sqrt(rate) + 40
    first = F.greatest(F.floor(rate - reach), F.lit(0)).cast("long")
    last = F.ceil(rate + reach).cast("long")
    # The first term's logarithm by Stirling's series, where the window starts above 0, at rates over some 215.
    x = F.greatest(first, F.lit(1)).cast("double")
    log_factorial = x * F.log(x) - x + F.log(2 * F.lit(3.141592653589793) * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    start_term = F.when(first > 0, F.exp(x * F.log(rate) - rate - log_factorial)).otherwise(F.exp(-rate))
    step = lambda a, i: F.struct(
        (a["k"] + F.when(a["cdf"] <= u, 1).otherwise(0)).alias("k"),
        (a["term"] * rate / i).alias("term"),
        (a["cdf"] + a["term"] * rate / i).alias("cdf"),
    )
    start = F.struct(first.alias("k"), start_term.alias("term"), start_term.alias("cdf"))
    return F.aggregate(F.sequence(first + 1, last), start, step, lambda a: a["k"])


def replicate(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed: int = SEED, alpha: float = ALPHA, total: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` exploded by count and in global random order, plus copy, n_copies, rate, order_key
    (under other names where ``docs`` has those already)."""
    by_source = rates(docs, source, alpha, total, weights)
    few = by_source.limit(MOST_BROADCAST_SOURCES + 1).count() <= MOST_BROADCAST_SOURCES
    key, side_source, rate, count, copy, order = (fresh(docs, x) for x in ("mix_key", "mix_source", "rate", "n_copies", "copy", "order_key"))
    side = by_source.select(F.col("mix_source").alias(side_source), F.col("rate").alias(rate))
    known = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    df = docs.withColumn(key, known).join(F.broadcast(side) if few else side, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(side_source)))
    df = df.withColumn(count, poisson_inverse(uniform(F.col(key), seed), F.col(rate))).filter(F.col(count) > 0)
    df = df.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    df = df.withColumn(order, F.md5(F.concat(F.lit(f"{seed}/"), F.col(key), F.lit("/"), F.col(copy).cast("string"))))
    # Equal hashes of a random key: partitions are even, and their order is the order of the key inside each.
    return df.drop(key, side_source).repartition(order).sortWithinPartitions(order)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    df = replicate(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "source", "lang", "text", "copy", "n_copies", F.round("rate", 9).alias("rate"), "order_key")


OP4_SQL = f"""
WITH n AS (SELECT source, count(*) AS n_docs, pow(count(*)::DOUBLE, {ALPHA}) AS weight FROM documents GROUP BY source),
s AS (SELECT sum(weight) AS w_sum, sum(n_docs) AS d_sum FROM n),
r AS (SELECT source, weight * d_sum::DOUBLE / w_sum / n_docs AS rate FROM n, s),
d AS (
  SELECT documents.*, rate, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS k FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source
), u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || k), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM d),
c AS (
  SELECT *, len(list_filter(range(0, 80), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: exp(-rate) * pow(rate, i) / gamma(i + 1))) <= u))::BIGINT AS n_copies FROM u
), e AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM c WHERE n_copies > 0)
SELECT doc_id, source, lang, text, copy, n_copies, round(rate, 9) AS rate, md5('{SEED}/' || k || '/' || copy) AS order_key FROM e
"""
