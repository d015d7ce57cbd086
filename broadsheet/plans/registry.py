"""All registered queries of the news engine, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import coverage, editorial, listings, personal, titles

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (titles, listings, personal, editorial, coverage)


def queries() -> dict[str, Query]:
    return {f.__name__: f for part in PARTS for f, _ in part.ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for part in PARTS for f, sql in part.ALL if sql}
