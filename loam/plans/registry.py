"""Registry of checkable queries: a Spark callable and its DuckDB SQL twin.

Every query reads the given tables (``<sf_dir>/<name>.parquet``) and runs the
library's own operators on them.  Computed doubles are rounded to ``DIGITS``
decimals on both sides so that summation order cannot flip the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.sources.readers import read_table

DIGITS = 4

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (report output)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def per_column_sql(cols: list[str], template: str, joiner: str = "\nUNION ALL\n") -> str:
    """Expand ``template`` (with ``{c}``) once per column and union the pieces."""
    return joiner.join(template.replace("{c}", c) for c in cols)
