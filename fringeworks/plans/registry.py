"""All queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Every other column rounded as a double; sums of doubles depend on their order."""
    return df.select(*(F.col(c) if c in keep else (F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in df.columns))


from . import beam_queries, image_queries, partition_queries, prior_queries, product_queries, sky_queries, solver_queries, source_queries, vis_queries  # noqa: E402, F401
