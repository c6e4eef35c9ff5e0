"""Registration of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsquant.session import ship_package
from newsquant.sources.tables import FORECASTS_SQL, NEWS_SQL, PRICES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEWS = {"news": [NEWS_SQL], "prices": [PRICES_SQL], "forecasts": [PRICES_SQL, FORECASTS_SQL]}


def query(name: str, views: str = "", ctes: str = "", sql: str | None = None):
    """Register a query; `sql` may use the named views and extra `ctes`."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            parts: list[str] = []
            for v in views.split():
                parts += [p for p in _VIEWS[v] if p not in parts]
            if ctes:
                parts.append(ctes.strip().rstrip(","))
            ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
        return fn

    return register
