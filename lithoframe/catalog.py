"""The registered queries and their SQL, gathered from the modules of plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import attribute_queries, edit_queries, point_queries, registry_queries, solver_queries, spatial_queries, surface_queries

MODULES: tuple = (attribute_queries, spatial_queries, point_queries, registry_queries, solver_queries, edit_queries, surface_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
