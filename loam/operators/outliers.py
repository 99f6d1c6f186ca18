"""Outliers and range rules.

Statistics (mean/std or exact quartiles) are one aggregate per call and come
back as one row per column; the per-row tests are lazy projections/filters
with those numbers as literals, so they stay inside whole-stage codegen and
push down to the scan.

A z-score is undefined when the value is missing or the std is 0/missing; such
rows are never counted and never removed (pandas would delete them on removal).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.schema import numeric_columns
from loam.functions.stats import clean_double, safe_z
from loam.operators.ordered import cumulative_sums
from loam.operators.quantiles import long_values, quantile_map
from loam.session import remove, stored

IQR_FENCE = 1.5
METHODS = ("zscore", "iqr")

# Range rules by column-name substring, as (substring, low, high);
# None means unbounded.  Checked in this order.
RANGE_RULES = (
    ("age", 0.0, 120.0),
    ("height", 0.0, 300.0),
    ("weight", 0.0, None),
    ("price", 0.0, None),
    ("score", 0.0, 100.0),
)


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown outlier method: {method}")


def mean_std(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """``{column: (mean, sample std)}`` from one aggregate (bounded: one pair per column)."""
    if not columns:
        return {}
    # long form: one grouped aggregate whatever the number of columns
    rows = (long_values(df, list(columns)).groupBy("column_name")
            .agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect())
    got = {r["column_name"]: (r["m"], r["s"]) for r in rows}
    return {c: got.get(c, (None, None)) for c in columns}


def iqr_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """``{column: (low fence, high fence)}`` from exact linear quartiles."""
    q = quantile_map(df, list(columns), [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None or q3 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - IQR_FENCE * iqr, q3 + IQR_FENCE * iqr)
    return out


def _z(c: str, mean, std) -> Column:
    if mean is None or std is None:
        return F.lit(None).cast("double")
    return safe_z(clean_double(F.col(c)), F.lit(mean), F.lit(std))


def _outside(c: str, lo, hi) -> Column:
    x = clean_double(F.col(c))
    if lo is None:
        return F.lit(False)
    return (x < F.lit(lo)) | (x > F.lit(hi))


def detect_outliers(df: DataFrame, method: str = "zscore", threshold: float = 3.0,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, n_outliers)`` per numeric column.

    zscore: ``|x - mean| / std > threshold`` (sample std).  iqr: outside
    ``[q1 - 1.5 iqr, q3 + 1.5 iqr]`` (the threshold does not apply).
    """
    _check(method)
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_outliers long")
    if method == "zscore":
        st = mean_std(df, columns)
        tests = {c: F.coalesce(_z(c, *st[c]) > threshold, F.lit(False)) for c in columns}
    else:
        fences = iqr_fences(df, columns)
        tests = {c: F.coalesce(_outside(c, *fences[c]), F.lit(False)) for c in columns}
    from loam.operators.profile import _wide_to_long
    per = {c: F.struct(F.count_if(tests[c]).cast("long").alias("n_outliers")) for c in columns}
    return _wide_to_long(df, per)


def remove_outliers(df: DataFrame, method: str = "zscore", threshold: float = 3.0,
                    columns: Sequence[str] | None = None, mode: str = "sequential") -> DataFrame:
    """Drop outlier rows.

    ``sequential`` (reference behaviour): columns in schema order, the
    statistics of each column recomputed on the rows that survived the
    previous ones (zscore: one aggregate per column; iqr: three scans for all columns, see
    ``sequential_fences``).  ``simultaneous``: all statistics
    from the input, one filter.  IQR fences are inclusive.
    """
    _check(method)
    columns = list(columns) if columns is not None else numeric_columns(df)
    if mode == "simultaneous":
        keep = _keep_all(df, method, threshold, columns)
        return df.where(keep) if keep is not None else df
    if mode != "sequential":
        raise ValueError(f"unknown removal mode: {mode}")
    if method == "iqr" and len(columns) > 1 and (fences := sequential_fences(df, columns)) is not None:
        keep = F.lit(True)
        for c, (lo, hi) in fences.items():
            keep = keep & F.coalesce(~_outside(c, lo, hi), F.lit(True))
        return df.where(keep)
    out = df
    for c in columns:
        keep = _keep_all(out, method, threshold, [c])
        if keep is not None:
            out = out.where(keep)
    return out


# Steps, as shares of the rows, by which a quartile may be off, and shares of rows outside a fence.
_STEPS = (5e-4, 1e-3, 2e-3, 5e-3, 0.01, 0.02, 0.05, 0.1)
_TAILS = (5e-4, 1e-3, 2e-3, 5e-3, 0.01, 0.02, 0.05, 0.1)
_ACCURACY = 10_000
#: Numbers that the driver may take to find the fences by itself; beyond that the ranks are found by jobs.
_COLLECTED = 2_000_000


@dataclass
class _Bracket:
    """Where the quartiles of a column must lie, whatever earlier columns remove, and what no fence can cut off."""
    q1: tuple[float, float]
    q3: tuple[float, float]
    inside: tuple[float, float]


def _brackets(df: DataFrame, columns: Sequence[str]) -> dict[str, _Bracket] | None:
    """One scan of mergeable sketches; None where too many rows may go to tell the quartiles beforehand."""
    probs = sorted({0.0, 1.0, *(p + s * d for p in (0.25, 0.75) for d in _STEPS for s in (-1, 1)), *_TAILS, *(1 - t for t in _TAILS)})
    row = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.percentile_approx(clean_double(F.col(c)), [float(p) for p in probs], _ACCURACY).alias(f"q{i}"), F.count(clean_double(F.col(c))).alias(f"n{i}"),
        F.min(clean_double(F.col(c))).alias(f"lo{i}"), F.max(clean_double(F.col(c))).alias(f"hi{i}"))]).first()
    out, removed, slack = {}, 0.0, 2.0 / _ACCURACY
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if not n:
            continue
        at = dict(zip(probs, row[f"q{i}"]))
        wide = next((d for d in _STEPS if d >= slack + 2.0 / n + removed / n), None)
        if wide is None:
            return None
        a1, b1, a3, b3 = (at[p + s * wide] for p in (0.25, 0.75) for s in (-1, 1))
        inside = ((1 + IQR_FENCE) * b1 - IQR_FENCE * a3, (1 + IQR_FENCE) * a3 - IQR_FENCE * b1)
        below = 0.0 if row[f"lo{i}"] >= inside[0] else next((t + slack for t in _TAILS if at[t] >= inside[0]), None)
        above = 0.0 if row[f"hi{i}"] <= inside[1] else next((t + slack for t in _TAILS if at[1 - t] <= inside[1]), None)
        if below is None or above is None:
            return None
        removed += (below + above) * n
        out[c] = _Bracket((a1, b1), (a3, b3), inside)
    return out


def sequential_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple] | None:
    """``{column: (low, high)}`` of sequential IQR trimming in three scans, whatever the number of columns.

    1. Sketches of all columns bound each quartile, with room for all that the columns before may remove.
    2. Rows inside every possible fence certainly stay.  They are counted by zone: below a quartile's
       bracket, inside it (by value), between the brackets.
    3. The other rows are few; which of them stay is decided column by column.

    A quartile is then an order statistic among the values in its bracket.  None where the brackets
    would have to be wide (many outliers, or mass at a border); callers then trim column by column.
    """
    brackets = _brackets(df, columns)
    if not brackets:
        return None
    names = list(brackets)
    x = {c: clean_double(F.col(c)) for c in names}
    stays = F.lit(True)
    for c, b in brackets.items():
        stays = stays & F.coalesce(x[c].between(*b.inside), F.lit(True))

    def zone(i: int, c: str) -> Column:
        (a1, b1), (a3, b3) = brackets[c].q1, brackets[c].q3
        z = F.when(x[c] < a1, 0).when(x[c] <= b1, 1).when(x[c] < a3, 2).when(x[c] <= b3, 3).otherwise(4)
        return F.struct(F.lit(i).alias("c"), F.when(x[c].isNotNull(), z).alias("z"), F.when(z.isin(1, 3), x[c]).alias("v"))
    zones, zones_at = stored(df.where(stays).select(F.inline(F.array(*[zone(i, c) for i, c in enumerate(names)])))
                             .where("z is not null").groupBy("c", "z", "v").agg(F.count("*").alias("n")))
    open_rows, open_at = stored(df.where(~stays).select(*[x[c].alias(f"x{i}") for i, c in enumerate(names)]))
    try:
        small = zones.count() * 3 + open_rows.count() * len(names) <= _COLLECTED
        solve = _Collected(zones, open_rows) if small else _Spread(zones, open_rows)
        fences: dict[str, tuple] = {c: (None, None) for c in columns}
        for i, c in enumerate(names):
            (a1, b1), (a3, b3) = brackets[c].q1, brackets[c].q3
            counts, n = solve.counts(i, (a1, b1, a3, b3))
            if not n:
                continue
            quartiles = []
            for p, before, held, lo, hi in ((0.25, counts[0], counts[1], a1, b1), (0.75, sum(counts[:3]), counts[3], a3, b3)):
                if b1 >= a3:  # the brackets overlap: the zones cannot tell them apart
                    return None
                at = (n - 1) * p
                k = int(at)
                ranks = [k, min(k + 1, n - 1)]
                if ranks[0] < before or ranks[1] >= before + held:
                    return None
                v0, v1 = solve.values(i, lo, hi, [r - before for r in ranks])
                quartiles.append(v0 + (v1 - v0) * (at - k))
            iqr = quartiles[1] - quartiles[0]
            fences[c] = (quartiles[0] - IQR_FENCE * iqr, quartiles[1] + IQR_FENCE * iqr)
            solve.trim(i, *fences[c])
        return fences
    finally:
        remove(df.sparkSession, zones_at)
        remove(df.sparkSession, open_at)


class _Collected:
    """Zones and open rows small enough for the driver (their number was checked)."""

    def __init__(self, zones: DataFrame, rows: DataFrame):
        got = zones.collect()
        self.zone = np.array([(r["c"], r["z"], r["n"]) for r in got], np.int64).reshape(-1, 3)
        self.value = np.array([np.nan if r["v"] is None else r["v"] for r in got], float)
        self.rows = np.array([[np.nan if v is None else v for v in r] for r in rows.collect()], float).reshape(-1, len(rows.columns))

    def counts(self, i: int, cuts) -> tuple[list[int], int]:
        a1, b1, a3, b3 = cuts
        mine = self.zone[self.zone[:, 0] == i]
        x = self.rows[:, i]
        open_ = [(x < a1).sum(), ((x >= a1) & (x <= b1)).sum(), ((x > b1) & (x < a3)).sum(), ((x >= a3) & (x <= b3)).sum(), (x > b3).sum()]
        out = [int(mine[mine[:, 1] == z, 2].sum() + open_[z]) for z in range(5)]
        return out, sum(out)

    def values(self, i: int, lo: float, hi: float, ranks: list[int]) -> list[float]:
        held = (self.zone[:, 0] == i) & (self.value >= lo) & (self.value <= hi)
        x = self.rows[:, i]
        x = x[(x >= lo) & (x <= hi)]
        v, n = np.concatenate([self.value[held], x]), np.concatenate([self.zone[held, 2], np.ones(len(x), np.int64)])
        order = np.argsort(v, kind="stable")
        up = np.cumsum(n[order])
        return [float(v[order][np.searchsorted(up, r, "right")]) for r in ranks]

    def trim(self, i: int, lo: float, hi: float) -> None:
        x = self.rows[:, i]
        self.rows = self.rows[~((x < lo) | (x > hi))]


class _Spread:
    """The same by jobs on the zones and open rows alone."""

    def __init__(self, zones: DataFrame, rows: DataFrame):
        self.zones, self.rows = zones, rows

    def counts(self, i: int, cuts) -> tuple[list[int], int]:
        a1, b1, a3, b3 = cuts
        got = {r["z"]: r["n"] for r in self.zones.where(F.col("c") == i).groupBy("z").agg(F.sum("n").alias("n")).collect()}
        x = F.col(f"x{i}")
        row = self.rows.agg(*[F.count_if(t).alias(f"z{z}") for z, t in enumerate(
            (x < a1, x.between(a1, b1), (x > b1) & (x < a3), x.between(a3, b3), x > b3))]).first()
        out = [int(got.get(z, 0) + row[z]) for z in range(5)]
        return out, sum(out)

    def values(self, i: int, lo: float, hi: float, ranks: list[int]) -> list[float]:
        held = self.zones.where((F.col("c") == i) & F.col("v").between(lo, hi)).select("v", "n").unionByName(
            self.rows.where(F.col(f"x{i}").between(lo, hi)).select(F.col(f"x{i}").alias("v"), F.lit(1).cast("long").alias("n")))
        up = cumulative_sums(held.groupBy("v").agg(F.sum("n").alias("n")), "v", ["n"])
        row = up.agg(*[F.min(F.when(F.col("cum_n") > r, F.col("v"))).alias(f"r{j}") for j, r in enumerate(ranks)]).first()
        return [float(v) for v in row]

    def trim(self, i: int, lo: float, hi: float) -> None:
        x = F.col(f"x{i}")
        self.rows = self.rows.where(F.coalesce(~((x < lo) | (x > hi)), F.lit(True)))


def _keep_all(df: DataFrame, method: str, threshold: float, columns: list[str]) -> Column | None:
    if method == "zscore":
        st = mean_std(df, columns)
        tests = [F.coalesce(_z(c, *st[c]) <= threshold, F.lit(True)) for c in columns]
    else:
        fences = iqr_fences(df, columns)
        tests = [F.coalesce(~_outside(c, *fences[c]), F.lit(True)) for c in columns]
    keep = None
    for t in tests:
        keep = t if keep is None else keep & t
    return keep


def list_outliers(df: DataFrame, key: Sequence[str], threshold: float = 3.0,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """E5: one row per outlying value: ``(key..., column_name, value, z, mean, std, threshold)``."""
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in key]
    st = mean_std(df, columns)
    stats = df.sparkSession.createDataFrame(
        [(c, st[c][0], st[c][1]) for c in columns], "column_name string, mean double, std double")
    lv = long_values(df, columns, group_cols=list(key))
    # stats: one row per column, a bounded broadcast
    z = safe_z(F.col("value"), F.col("mean"), F.col("std"))
    return (lv.join(F.broadcast(stats), "column_name")
            .withColumn("z", z).where(F.col("z") > threshold)
            .select(*key, "column_name", "value", "z", "mean", "std", F.lit(float(threshold)).alias("threshold")))


def fix_ranges(df: DataFrame, rules=RANGE_RULES) -> tuple[DataFrame, list[tuple]]:
    """A numeric column whose lower-cased name contains a rule's substring has
    out-of-range values replaced by the column median (median taken before the fix,
    over all values).  Rules apply in order; returns ``(frame, log)``."""
    todo = {c: [r for r in rules if r[0] in c.lower()] for c in numeric_columns(df)}
    out, log = df, []
    for turn in range(max(map(len, todo.values()), default=0)):
        # the turn-th rule of every column: one aggregate counts, one quantile run gives all medians
        due = {c: r[turn] for c, r in todo.items() if len(r) > turn}
        bad = {}
        for c, (_, lo, hi) in due.items():
            x = clean_double(F.col(c))
            low = (x < F.lit(lo)) if lo is not None else F.lit(False)
            bad[c] = low | (x > F.lit(hi)) if hi is not None else low
        counts = out.agg(*[F.count_if(b).alias(c) for c, b in bad.items()]).first()
        hit = [c for c in due if counts[c]]
        medians = quantile_map(out, hit, [0.5])
        out = out.withColumns({c: F.when(bad[c], F.lit(medians[c, 0.5])).otherwise(clean_double(F.col(c))) for c in hit})
        log += [(c, due[c][0], counts[c], medians[c, 0.5]) for c in hit]
    return out, log
