"""Packing by optimal length buckets, then token-budget batches inside each.

Lengths are tokens of ``tokenizer`` where one is given, else ``length``, else words.
Padding a batch to its bucket's limit wastes limit - length per document. The
lengths' exact histogram over the whole corpus goes to the driver: T tokens have fewer
than sqrt(2 T) + 1 distinct lengths. Dynamic programming finds the limits that waste least. Every document is
then ranked inside its bucket, in hash order, and every ``budget // limit``
documents form a batch. The ranks come from shards of bounded size and their
running counts, never from one window over a bucket.

Defined cases: a null or empty text has length 0 and goes to the first bucket; a
text longer than the budget is alone in its batch; nothing is cut or dropped;
repeated rows are ranked one by one, and rows with equal ids and texts are alike,
so their order doesn't matter; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, durable, table
from .tokens import count_tokens, default_path

BUCKETS = 12
BUDGET = 1 << 15
EXACT = 1024
STEPS = 128
#: Greatest number of histogram bins: exact ones and STEPS per doubling up to 2 ** 40.
BINS = EXACT + STEPS * 30
#: Rows of a shard: about 4096 shards in all, between these bounds.
SHARD_ROWS, MOST_SHARD_ROWS = 1000, 200_000
SEED = 10


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE + "+")).cast("long")


def bin_top(length: Column) -> Column:
    """The greatest length of the length's bin."""
    doubling = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / EXACT)) + 1
    width = F.pow(F.lit(2.0), doubling) * (EXACT / 2 / STEPS)
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / width) * width).cast("long"))


def best_limits(tops: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Limits of at most ``buckets`` groups of neighbouring bins with the least padding.

    cost(i, j) = top_j * (N_j - N_i) - (S_j - S_i) over prefix sums; the terms that hold no i
    leave a minimum of f(i) - top_j * N_i: lines in top_j, whose lower envelope is walked once
    per bucket, so time goes with bins times buckets. Ties go to the least i.
    """
    tops, counts = [int(x) for x in tops], [int(x) for x in counts]
    m = len(tops)
    if m == 0:
        return []
    n = [0, *accumulate(counts)]
    best: list[int | None] = [0] + [None] * m
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = [0] + [None] * m, [0] * (m + 1)
        hull: list[int] = []
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                c = j - 1
                while hull and n[hull[-1]] == n[c] and best[c] < best[hull[-1]]:
                    hull.pop()
                if not hull or n[hull[-1]] != n[c]:
                    while len(hull) > 1:
                        a, b = hull[-2], hull[-1]
                        # b is never strictly best if c meets a no later than b does.
                        if (best[c] - best[a]) * (n[b] - n[a]) > (best[b] - best[a]) * (n[c] - n[a]):
                            break
                        hull.pop()
                    hull.append(c)
                at = min(at, len(hull) - 1)
            top = tops[j - 1]
            value = lambda i: best[i] - top * n[i]  # noqa: E731, B023
            while at + 1 < len(hull) and value(hull[at + 1]) < value(hull[at]):
                at += 1
            cut[j] = hull[at]
            new[j] = value(hull[at]) + top * n[j]
        cuts.append(cut)
        best = new
    limits, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        limits.append(tops[j - 1])
        j = cut[j]
    return limits[::-1]


def length_histogram(lengths: DataFrame, length="length", most: int | None = None) -> list[tuple[int, int]]:
    """(length, count), ascending: exact at any size, unless the caller asks for bins beyond ``most`` lengths."""
    exact = lengths.groupBy(F.col(length).alias("top")).agg(F.count("*").alias("n"))
    found = exact.collect() if most is None else exact.limit(most + 1).collect()
    if most is not None and len(found) > most:
        found = exact.groupBy(bin_top(F.col("top")).alias("top")).agg(F.sum("n").alias("n")).collect()
    return sorted((r["top"], r["n"]) for r in found)


def pack(docs: DataFrame, doc_id="doc_id", text="text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, length, bucket, bucket_limit, batch, slot), one per input row."""
    size = n_words(F.col(f"`{text}`")) if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))
    if tokenizer is not None:
        rows = durable(count_tokens(docs, tokenizer, doc_id, text, key).select("doc_id", F.col("n_tokens").alias("length"), "key"))
    else:
        rows = durable(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("length"), key.alias("key")))
    found = length_histogram(rows)
    limits = best_limits(np.array([t for t, _ in found]), np.array([n for _, n in found]), buckets)
    shard_rows = min(max(sum(n for _, n in found) // 4096, SHARD_ROWS), MOST_SHARD_ROWS)
    in_bucket = [0] * max(1, len(limits))
    for top, n in found:
        in_bucket[bisect_left(limits, top)] += n
    shards = F.array(*[F.lit(max(1, -(-n // shard_rows))) for n in in_bucket])
    limit_array = F.array(*[F.lit(x).cast("long") for x in limits]) if limits else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(limit_array, lambda x: x < F.col("length"))).cast("long"))
    rows = rows.withColumn("bucket_limit", F.get(limit_array, F.col("bucket").cast("int")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.get(shards, F.col("bucket").cast("int"))))
    inside = Window.partitionBy("bucket", "shard").orderBy("key", "doc_id")
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "shard"])
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_limit", F.lit(1))), F.lit(1))
    at = F.col("offset") + F.col("rank")
    return ranked.select("doc_id", "length", "bucket", "bucket_limit", F.floor(at / capacity).cast("long").alias("batch"), (at % capacity).cast("long").alias("slot"))


def op10_pack_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=default_path())
