"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, so that summation order cannot show."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
