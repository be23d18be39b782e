"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, sourced, versions


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in (catalogue, versions, sourced) for name, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in (catalogue, versions, sourced) for name, sql in part.SQL.items()}
