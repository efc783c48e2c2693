"""Registry of named queries: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    its oracle (omitted for operators that SQL cannot express)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Output formatting shared by queries so Spark and DuckDB hash the same values.
def dec(c: Column | str, scale: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal(38,{scale})")


def iso(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def joined(c: Column | str) -> Column:
    """Array of strings as comma-joined text ('' for empty)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_join(c, ","), F.lit(""))


SQL_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


def sql_dec(expr: str, scale: int = 6) -> str:
    return f"CAST({expr} AS DECIMAL(38,{scale}))"


def sql_iso(expr: str) -> str:
    return SQL_ISO.format(expr)
