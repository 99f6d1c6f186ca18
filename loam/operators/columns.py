"""Column-level helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import standard_name, standardize_names


def standardize_column_names(df: DataFrame, target: str | None = None):
    """B1: names lower-cased, blanks and hyphens to ``_``; collisions get ``_2``...

    Returns ``(frame, {old: new}, new_target)``.
    """
    new = standardize_names(df.columns)
    mapping = dict(zip(df.columns, new))
    out = df.toDF(*new)
    return out, mapping, (mapping.get(target, standard_name(target)) if target else None)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B2."""
    return df.drop(*columns)


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Exactly ``columns`` in that order; missing ones are added as ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def split_features_target(df: DataFrame, target: str):
    """``(features frame, target frame)``; a missing target raises ``ValueError``."""
    lower = {c.lower(): c for c in df.columns}
    if target.lower() not in lower:
        raise ValueError(f"no column {target} to split off; there are {', '.join(df.columns)}")
    t = lower[target.lower()]
    return df.drop(t), df.select(t)


def add_columns(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Column-wise concatenation of derived columns (no join)."""
    return df.withColumns(dict(derived))
