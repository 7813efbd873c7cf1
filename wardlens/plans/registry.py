"""Named queries: a Spark plan over the tables, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlens.sources.fixtures import with_fixtures
from wardlens.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = build
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return build

    return register


def r2(expression: str) -> str:
    """Oracle text for a half-away-from-zero rounding to two digits."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38, 12)), 2) AS DOUBLE)"


def r4(expression: str) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38, 12)), 4) AS DOUBLE)"


def bound_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in PLANS.items()}
