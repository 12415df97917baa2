"""Corpus pipeline: quality rules, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.

Defined cases: a null or empty text has no words, so the rules reject it; very long
texts go whole through every stage; null ids, sources and languages are kept, a null
source is a source of its own; of repeated rows and copies that of the least id stays
(null ids last); an empty table, or one whose documents all go, gives no rows; more
columns, whatever their names, stay up to the last stage, whose rows are one per copy
that mixing made: several of one document differ in batch and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hyperloom.llm import mixing, neardup, packing, quality, secrets, tokens
from hyperloom.llm.common import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy of the rule ledger rejects go."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least id."""
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that are no widely copied examples are masked; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights, in global random order."""
    return mixing.replicate(docs).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy gets its bucket by token length, batch and slot."""
    return packing.pack(docs, tokenizer=tokens.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Near duplicates have no SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
