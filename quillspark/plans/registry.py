"""Where queries over the driver's tables, and SQL that gives the same, are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_LATER: dict[str, Callable[[], str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL; SQL that is made of parts further down in a module is given as a function, see fill_in()."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if callable(sql):
            _LATER[name] = sql
        elif sql:
            SQL[name] = sql
        return f

    return add


def fill_in() -> None:
    SQL.update({name: sql() for name, sql in _LATER.items()})
    _LATER.clear()
