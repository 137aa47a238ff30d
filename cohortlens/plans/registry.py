"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
plus, when the result is expressible in SQL, the equivalent DuckDB text used
as an independent oracle.  ``__spark_entry__`` exposes both dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle (None = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ensure_checkpoint_dir, ship_package
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return rounded(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column so both engines hash the same values."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(name))
    return df.select(*cols)


def union_sql(cols: list[str], source: str = "cohort", value_type: str = "DOUBLE", extra: str = "") -> str:
    """UNION ALL of one (variable, x) block per column: a plain-SQL unpivot."""
    sep = ", " if extra else ""
    return "\nUNION ALL\n".join(
        f"SELECT {extra}{sep}'{c}' AS variable, CAST({c} AS {value_type}) AS x FROM {source}" for c in cols)
