"""Schema-driven column selection (pandas ``select_dtypes`` counterparts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric physical type, booleans excluded (``np.number``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    """String columns (pandas ``object``/``category``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns of scalar type; arrays, maps and structs are passed through unprofiled."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def select_by_kind(df: DataFrame, kind: str) -> list[str]:
    """Column list for ``numeric``, ``text`` (strings), ``datetime`` or ``boolean``."""
    table = {"numeric": numeric_columns, "text": string_columns,
             "datetime": datetime_columns, "boolean": boolean_columns}
    if kind not in table:
        raise ValueError(f"unknown column kind: {kind}")
    return table[kind](df)
