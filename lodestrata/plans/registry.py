"""All registered queries and, under the same keys, their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register (spark, sf_dir) -> DataFrame and the DuckDB SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


for _module in ("git_queries", "code_queries", "scalar_queries", "graph_queries", "memory_queries", "service_queries", "source_queries", "store_queries"):
    importlib.import_module(f"lodestrata.plans.{_module}")
