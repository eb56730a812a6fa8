"""Registry of queries and their expected results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.ctes import sql
from workload.inputs import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, expected: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL of its expected result."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if expected is not None:
            EXPECTED[name] = expected
        return fn

    return add


def oracles() -> dict[str, str]:
    """The SQL of every expected result, with the blocks it names, whatever module was imported first."""
    from workload import feature_ctes, q_dimensions, q_jobs, q_reports, q_streams, q_structure, q_urls  # noqa: F401  (they fill the block table)

    return {name: sql(body) for name, body in EXPECTED.items()}
