"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanewright.plans import candidate_queries, geometry_queries, graph_queries, map_queries, region_queries

_ALL = graph_queries.QUERIES | geometry_queries.QUERIES | candidate_queries.QUERIES | map_queries.QUERIES | region_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
