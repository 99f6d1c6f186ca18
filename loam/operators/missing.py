"""Missing values.

Fill values are statistics (one per column) computed by distributed
aggregates: exact median for numeric columns, most frequent value (smallest on
a tie) for categorical ones.  The fill itself is a lazy projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.schema import numeric_columns
from loam.operators.profile import missing_counts, value_mode
from loam.operators.quantiles import quantile_map

TEXT_PLACEHOLDER = "MISSING"
FILL_LOG_SCHEMA = "column_name string, semantic_type string, missing long, strategy string, fill_value string"


def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop(how="any")


def _fill_expr(c: str, dtype: T.DataType, value):
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = F.when(F.isnan(col), F.lit(None)).otherwise(col)
    return F.coalesce(col, F.lit(value)).alias(c)


def fit_imputation(df: DataFrame, types: dict[str, str],
                   evidence: dict[str, dict] | None = None) -> list[tuple[str, str, int, str, object]]:
    """D3-D5 fit: ``(column, type, missing, strategy, fill)`` for columns with missing values.

    numeric: exact median; categorical: mode (smallest on a tie; an all-missing
    column keeps NULL and is logged); text: ``"MISSING"``; datetime: left alone.
    ``evidence`` (from type detection on the same rows) supplies the missing
    counts without another pass; modes are computed only for categorical
    columns that have gaps (fewer than 50 distinct values each, so their value
    counts are a small shuffle).
    """
    if evidence is not None:
        miss = {c: int(e["n_rows"] - e["non_null"]) for c, e in evidence.items()}
    else:
        miss = {r["column_name"]: r["missing"] for r in missing_counts(df).collect()}
    todo = [c for c in df.columns if miss.get(c, 0) > 0]
    num = [c for c in todo if types.get(c, "text") == "numeric"]
    cat = [c for c in todo if types.get(c, "text") == "categorical"]
    med = quantile_map(df, num, [0.5]) if num else {}
    modes = {r["column_name"]: r["mode"] for r in value_mode(df, cat).collect()} if cat else {}
    plan = []
    for c in todo:
        t = types.get(c, "text")
        if t == "numeric":
            plan.append((c, t, miss[c], "median", med[(c, 0.5)]))
        elif t == "categorical":
            plan.append((c, t, miss[c], "mode", modes.get(c)))
        elif t == "text":
            plan.append((c, t, miss[c], "placeholder", TEXT_PLACEHOLDER))
        else:
            plan.append((c, t, miss[c], "none", None))
    return plan


def apply_imputation(df: DataFrame, plan: list[tuple]) -> DataFrame:
    fields = {f.name: f.dataType for f in df.schema.fields}
    fills = {c: v for c, _t, _m, s, v in plan if s != "none" and v is not None}
    return df.select(*[_fill_expr(c, fields[c], fills[c]) if c in fills else F.col(c) for c in df.columns])


def fill_log(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    rows = [(c, t, int(m), s, None if v is None else str(v)) for c, t, m, s, v in plan]
    return spark.createDataFrame(rows, FILL_LOG_SCHEMA)


def handle_missing(df: DataFrame, types: dict[str, str], strategy: str = "auto",
                   evidence: dict[str, dict] | None = None):
    """``strategy`` in ``auto``/``impute`` (typed fills) or ``drop``.

    Returns ``(frame, plan)``.  Unknown strategies raise ``ValueError``.
    """
    if strategy == "drop":
        return drop_missing_rows(df), []
    if strategy in ("auto", "impute"):
        plan = fit_imputation(df, types, evidence)
        return apply_imputation(df, plan), plan
    raise ValueError(f"unknown missing-value strategy: {strategy}")


def impute_by_dtype(df: DataFrame):
    """D6 (legacy): numeric physical columns get the median, every other column the mode."""
    nums = set(numeric_columns(df))
    types = {c: ("numeric" if c in nums else "categorical") for c in df.columns}
    plan = fit_imputation(df, types)
    return apply_imputation(df, plan), plan
