"""Registry of the named queries exposed by ``__spark_entry__``.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the test-data
views, optionally paired with DuckDB SQL that computes the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.plans.views_sql import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register a query under ``name``; ``sql`` (with ``views`` as CTEs) is its oracle."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return fn
    return deco


def finish(df: DataFrame, digits: int = 9) -> DataFrame:
    """Comparable output: doubles rounded, integral columns as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits))
        cols.append(c.alias(f.name))
    return df.select(*cols)
