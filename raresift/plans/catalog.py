"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB oracle text over the same tables.

Doubles are rounded to 6 places on both sides (sums of doubles differ in the
last bits by summation order); DuckDB adds ``+ 0.0`` to turn ``-0.0`` into 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def R(expr: str, digits: int = DIGITS) -> str:
    """DuckDB rounding text matching :func:`rounded`."""
    return f"(round({expr}, {digits}) + 0.0)"


def _round_col(c: Column, dt: T.DataType, digits: int) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.round(c.cast("double"), digits)
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType)):
        return F.transform(c, lambda v: F.round(v.cast("double"), digits))
    return c


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double (and array<double>) column."""
    return df.select(*[_round_col(F.col(f.name), f.dataType, digits).alias(f.name) for f in df.schema.fields])
