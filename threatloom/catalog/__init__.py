"""Queries over the test tables with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["traffic", "datasets", "evaluation", "files", "learning", "streams"]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """Name to query and SQL; no SQL where it cannot express the result."""
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        found.update(import_module(f"threatloom.catalog.{module}").QUERIES)
    return found
