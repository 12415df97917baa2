"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprint, html, mixing, neardup, packing, quality, secrets, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_html_extract": html.op8_html_extract,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_pack_buckets": packing.op10_pack_buckets,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op6_secret_scan": secrets.OP6_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
