"""All registered queries of the trade-network engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeloom.plans import edge_queries, graph_queries, intake_queries, search_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [edge_queries, graph_queries, search_queries, intake_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_queries.QUERIES["w9_edge_shares"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
