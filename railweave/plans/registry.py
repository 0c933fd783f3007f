"""Registered queries: a name, a Spark plan, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railweave.plans.roles import Roles, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False, **ctes: str):
    """Registers ``fn(roles) -> DataFrame``; without SQL only the rows are checked."""
    def register(fn: Callable[[Roles], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Roles(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = check_sql(sql, recursive, **ctes)
        return fn

    return register
