"""Text cleaning over whole frames (F1-F5 applied to every string column)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.schema import string_columns


def _map_strings(df: DataFrame, fn: Callable[[Column], Column], columns: Sequence[str] | None) -> DataFrame:
    cols = set(columns) if columns is not None else set(string_columns(df))
    return df.select(*[fn(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def clean_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """collapse whitespace runs (Unicode-aware) and trim, every string column."""
    return _map_strings(df, T.collapse_whitespace, columns)


def standardize_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """lower, strip, remove characters that are neither word characters nor blanks."""
    return _map_strings(df, T.standardize_text, columns)


def latin1_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """drop characters outside Latin-1."""
    return _map_strings(df, T.latin1_only, columns)


def ascii_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """non-ASCII runs become one space."""
    return _map_strings(df, T.ascii_runs_to_space, columns)


def sanitize_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F5 over values: characters unsafe in file names become ``_``."""
    return _map_strings(df, T.safe_identifier_expr, columns)
