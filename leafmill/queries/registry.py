"""Collects the registered queries and SQL of the core modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.queries import general, metadata, retrieval  # noqa: E402

MODULES: list = [retrieval, metadata, general]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.oracle_sql()
    return found
