"""All registered queries: name -> function of (spark, folder), and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.crosswalk import Tables, oracle
from . import cohort_queries, linkpred_queries, network_queries

DEFS = network_queries.DEFS | cohort_queries.DEFS | linkpred_queries.DEFS


def _query(build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Tables(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(d[0]) for name, d in DEFS.items()}
ORACLES: dict[str, str] = {name: oracle(d[1], *d[2:]) for name, d in DEFS.items() if d[1]}
