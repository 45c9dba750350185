"""Registered queries: each operator over the given tables, with the SQL that says the same."""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("casting", "rows", "statistics", "joins", "values", "sources", "builds", "search", "schemas", "pipelines", "scans")


def collected() -> dict[str, tuple[Query, str | None]]:
    """Name to query and SQL (None where SQL cannot express it), over all modules."""
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        found |= import_module(f"datakiln.queries.{module}").QUERIES
    return found
