"""Date parts (I1, I2), deterministic split (I3) and standard scaling (I4)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.dates import ISO, parse_date
from loam.functions.hashing import seeded_hash52
from loam.functions.stats import clean_double
from loam.functions.schema import DATETIME_TYPES
from loam.operators.quantiles import kth_smallest


def _as_timestamp(df: DataFrame, c: str, formats: dict[str, str]) -> Column:
    dt = dict((f.name, f.dataType) for f in df.schema.fields)[c]
    if isinstance(dt, DATETIME_TYPES):
        return F.col(c)
    # wall-clock time without a zone, whatever the session time zone
    return parse_date(F.col(c).cast("string"), formats.get(c, ISO)).cast("timestamp_ntz")


def extract_datetime_features(df: DataFrame, types: dict[str, str], formats: dict[str, str] | None = None) -> DataFrame:
    """For each ``datetime`` column, ``_year _month _day _dayofweek (Mon=0) _quarter``;
    text dates are converted to timestamps in place, the original is kept.

    ``formats`` are those of the text columns as fitted before (``semantic_types.date_formats``); without
    them they are told from ``df`` itself, which takes two aggregates.
    """
    from loam.operators.semantic_types import date_formats

    out = df
    if formats is None:
        formats = date_formats(df, [f.name for f in df.schema.fields if types.get(f.name) == "datetime"
                                    and isinstance(f.dataType, T.StringType)])
    for c, t in types.items():
        if t != "datetime" or c not in df.columns:
            continue
        out = out.withColumn(c, _as_timestamp(out, c, formats))
        ts = F.col(c)
        out = out.withColumns({f"{c}_year": F.year(ts), f"{c}_month": F.month(ts),
                               f"{c}_day": F.dayofmonth(ts), f"{c}_dayofweek": F.weekday(ts),
                               f"{c}_quarter": F.quarter(ts)})
    return out


def modelling_date_parts(df: DataFrame) -> DataFrame:
    """timestamp/date columns become ``_year _month _day _weekday`` and are dropped."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, DATETIME_TYPES):
            ts = F.col(f.name)
            out = out.withColumns({f"{f.name}_year": F.year(ts), f"{f.name}_month": F.month(ts),
                                   f"{f.name}_day": F.dayofmonth(ts), f"{f.name}_weekday": F.weekday(ts)})
            out = out.drop(f.name)
    return out


def split_hash(key: Sequence[str], seed: int = 42) -> Column:
    """52-bit seeded hash of the key (see ``loam.functions.hashing``)."""
    return seeded_hash52(key, seed)


def train_test_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42,
                     exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Deterministic split, the same rows under any partitioning.

    ``exact``: the test set holds exactly ``ceil(test_size * n)`` rows, those
    with the smallest hashes; the cut is one exact order statistic of the hash
    (distributed, no global sort).  Otherwise a hash bucket gives about
    ``test_size`` of the rows with no extra job.
    """
    h = split_hash(key, seed)
    keyed = df.withColumn("_split_h", h)
    if not exact:
        bucket = F.pmod(F.col("_split_h"), F.lit(10_000)) < F.lit(int(round(test_size * 10_000)))
        return keyed.where(~bucket).drop("_split_h"), keyed.where(bucket).drop("_split_h")
    n = df.count()
    n_test = math.ceil(test_size * n)
    if n_test <= 0:
        return df, df.limit(0)
    cut = kth_smallest(keyed.select("_split_h"), "_split_h", n_test - 1)
    is_test = F.col("_split_h") <= F.lit(cut)
    return keyed.where(~is_test).drop("_split_h"), keyed.where(is_test).drop("_split_h")


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """I4 fit: ``{column: (mean, population std)}`` of the training rows, one aggregate for each 20
    columns (five buffer fields each, so that code generation holds for any width)."""
    out = {}
    for at in range(0, len(columns), 20):
        some = list(columns)[at: at + 20]
        row = train.agg(*[f(clean_double(F.col(c))) for c in some for f in (F.avg, F.stddev_pop)]).first()
        out |= {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(some)}
    return out


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """I4 apply: ``(x - mean) / std``; a zero std divides by 1 (constant columns become 0)."""
    cols = []
    for c in df.columns:
        if c in stats:
            mean, std = stats[c]
            scale = std if std else 1.0
            cols.append(((F.col(c).cast("double") - F.lit(mean)) / F.lit(scale)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def numeric_feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    keep = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, keep) and f.name not in exclude]
