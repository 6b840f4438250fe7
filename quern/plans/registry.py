"""The decorator that registers a query with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.fixtures import duck


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = duck(sql)
            return f

        return put

    return queries, oracles, query


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at so many places (0 without a sign), so that the order of summation doesn't show."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
