"""Exact duplicate rows (G1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """G1: keep one row per distinct row (missing equals missing, as in pandas).

    One shuffle on the row hash; a heavily repeated row is collapsed by the
    map-side partial aggregation before it is shuffled.
    """
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def count_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> int:
    """Number of rows ``remove_duplicates`` drops."""
    return df.count() - remove_duplicates(df, subset).count()
