"""All queries of the library, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from finrecon.plans.shipping import shipped

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of that name."""

    def put(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shipped(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    import finrecon.plans.catalog  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import finrecon.plans.catalog  # noqa: F401

    return dict(_SQL)
