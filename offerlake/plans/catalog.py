"""Registry of the runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from offerlake.plans.views import ORACLE_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, operators: str, oracle: str | None = None, views: bool = True):
    """Registers a query; ``oracle`` is the select part over the canonical views."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} exists")
        sql = None if oracle is None else (ORACLE_VIEWS + oracle if views else oracle)
        CATALOG[name] = Query(name, operators, build, sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: runner(entry.build) for name, entry in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.oracle for name, entry in CATALOG.items() if entry.oracle}
