"""Profiling (EDA) operators: every result is a tidy DataFrame.

Moments come from one grouped aggregate over unpivoted ``(column_name, value)``
rows (no per-column jobs, code-generated whatever the column count); other
wide aggregates are chunked by buffer size; medians and quartiles come from
the exact distributed quantiles; value counts from ``groupBy(column_name,
value)`` with partial aggregation, so a hot value is combined on the map side
before any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.schema import numeric_columns, string_columns
from loam.functions.stats import clean_double, corrected_kurtosis, corrected_skew, safe_corr
from loam.operators.quantiles import approx_quantiles, exact_quantiles, long_values
from loam.session import materialise

# Whole-stage codegen is switched off for a plan node whose output has more than
# spark.sql.codegen.maxFields (100) fields; a partial aggregate outputs all of its
# buffers.  Wide aggregates are therefore cut into chunks of at most this many
# buffer fields (one scan per chunk, each fully code-generated).
AGG_FIELD_BUDGET = 90


def _chunks(items: Sequence[str], size: int):
    for i in range(0, len(items), size):
        yield list(items[i:i + size])


def _wide_to_long(df: DataFrame, per_column: Mapping[str, Column], name: str = "column_name",
                  width: int = 2) -> DataFrame:
    """One aggregate row of structs (one per item) unpivoted to one row per item.

    ``width`` is the number of aggregation-buffer fields one item needs.
    """
    frames = []
    cols = list(per_column)
    for chunk in _chunks(cols, max(1, AGG_FIELD_BUDGET // max(width, 1))):
        row = df.agg(*[per_column[c].alias(c) for c in chunk])
        frames.append(row.unpivot([], chunk, name, "s").select(name, "s.*"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _missing(c: str, dtype: T.DataType) -> Column:
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.count_if(col.isNull() | F.isnan(col))
    return F.count_if(col.isNull())


# ---------------------------------------------------------------- D1, D7, A10, J1

def missing_counts(df: DataFrame) -> DataFrame:
    """D1 + D7: ``(column_name, missing, missing_pct)`` for every column."""
    per = {f.name: F.struct(_missing(f.name, f.dataType).alias("missing"),
                            F.count(F.lit(1)).alias("n_rows"))
           for f in df.schema.fields}
    return (_wide_to_long(df, per)
            .select("column_name", F.col("missing").cast("long").alias("missing"),
                    (F.col("missing") * 100.0 / F.col("n_rows")).alias("missing_pct")))


def dataset_metadata(df: DataFrame) -> DataFrame:
    """``(column_name, position, dtype, missing, n_rows, n_columns)``."""
    fields = df.schema.fields
    per = {f.name: F.struct(_missing(f.name, f.dataType).cast("long").alias("missing"),
                            F.count(F.lit(1)).alias("n_rows"))
           for f in fields}
    meta = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "column_name string, position int, dtype string")
    return (_wide_to_long(df, per).join(F.broadcast(meta), "column_name")
            .select("column_name", "position", "dtype", "missing", "n_rows",
                    F.lit(len(fields)).alias("n_columns")))


# ---------------------------------------------------------------- J2, J8, J11

def moments(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., column_name, count, mean, std, var, min, max, skew, kurtosis)``.

    Long form: one grouped aggregate over ``(group..., column_name, value)``
    rows; its buffers stay far under the code-generation field limit whatever
    the number of columns.
    """
    keys = [*group_cols, "column_name"]
    x = F.col("value")
    n = F.count(x).cast("double")
    return long_values(df, columns, group_cols).groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"),
        corrected_skew(n, F.skewness(x)).alias("skew"), corrected_kurtosis(n, F.kurtosis(x)).alias("kurtosis"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None,
                    extended: bool = False, approx: bool = False) -> DataFrame:
    """``(column_name, mean, median, std, min, max, skew, kurtosis)``.

    Sample std, bias-corrected skew and excess kurtosis (pandas rules), exact
    median.  ``extended`` adds count, var, q25 and q75 (J8 describe).  The
    moments (one row per column) are checkpointed and also serve as the
    count/min/max pass of the quantiles, so the data is scanned once for both.
    ``approx`` takes the quantiles from one pass of bounded ``percentile_approx``
    sketches instead (a sample value within 1/10 000 of the rank, no interpolation).
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        # no numeric column: an empty summary, as the reference returns
        cols = ["mean", "median", "std", "min", "max", "skew", "kurtosis"] + (
            ["count", "var", "q25", "q75"] if extended else [])
        return df.sparkSession.createDataFrame(
            [], "column_name string, " + ", ".join(f"{c} {'long' if c == 'count' else 'double'}" for c in cols))
    mom = materialise(moments(df, columns))
    probs = [0.25, 0.5, 0.75] if extended else [0.5]
    stats = mom.select("column_name", F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))
    q = approx_quantiles(df, columns, probs) if approx else exact_quantiles(df, columns, probs, stats=stats)
    qw = q.groupBy("column_name").pivot("prob", probs).agg(F.first("value"))
    names = {0.25: "q25", 0.5: "median", 0.75: "q75"}
    qw = qw.select("column_name", *[F.col(f"`{p}`").alias(names[p]) for p in probs])
    out = mom.join(qw, "column_name", "left")
    base = ["column_name", "mean", "median", "std", "min", "max", "skew", "kurtosis"]
    if extended:
        base += ["count", "var", "q25", "q75"]
    return out.select(*base)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """J8 numeric describe: count, mean, std, var, min, q25, median, q75, max, mode."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    summ = numeric_summary(df, columns, extended=True)
    modes = value_mode(df, columns).select("column_name", F.col("mode").cast("double").alias("mode"))
    return (summ.join(modes, "column_name", "left")
            .select("column_name", "count", "mean", "std", "var", "min", "q25", "median", "q75", "max",
                    "mode"))


def grouped_descriptive(df: DataFrame, columns: Sequence[str] | None = None,
                        group_by: Sequence[str] = ()) -> DataFrame:
    """Per (group..., column_name): count, missing, mean, median, std, min, max.

    Rows whose group key is missing are left out, as pandas ``groupby`` does.
    """
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df)
                                                          if c not in group_by]
    group_by = list(group_by)
    for g in group_by:
        df = df.where(F.col(g).isNotNull())
    cols = [clean_double(F.col(c)).alias(c) for c in columns]
    allrows = (df.select(*group_by, *cols)
               .unpivot(group_by, columns, "column_name", "value"))
    keys = group_by + ["column_name"]
    mom = allrows.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.count_if(F.col("value").isNull()).cast("long").alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"))
    med = (exact_quantiles(df, columns, [0.5], group_cols=group_by,
                           long=allrows.where(F.col("value").isNotNull()))
           .select(*keys, F.col("value").alias("median")))
    return (mom.join(med, keys, "left")
            .select(*keys, "count", "missing", "mean", "median", "std", "min", "max"))


# ---------------------------------------------------------------- J3, J4, mode

def _string_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    return (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], list(columns), "column_name", "value")
            .where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, value, count)`` for every non-missing value."""
    columns = list(columns) if columns is not None else string_columns(df)
    return _string_long(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("count"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """``(column_name, rank, value, count)``; ties broken by value ascending."""
    vc = value_counts(df, columns)
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    return (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column_name", "rank", "value", "count"))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct count plus the top ``k`` values per string column."""
    vc = value_counts(df, columns)
    uniq = vc.groupBy("column_name").agg(F.count("*").alias("unique_values"))
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    top = (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    return (top.join(uniq, "column_name")
            .select("column_name", "unique_values", "rank", "value", "count"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, by_hash: bool = True) -> DataFrame:
    """Distinct count per column via one shuffle of ``(column, key)`` pairs.

    ``by_hash`` shuffles a 96-bit key (``xxhash64`` and murmur3 of the value)
    instead of the value itself, so long texts are not moved to count them;
    two different values count once only if both hashes collide (about one
    chance in 2^96 per pair).  ``by_hash=False`` shuffles the values.
    """
    columns = list(columns) if columns is not None else list(df.columns)
    lv = _string_long(df, columns)
    if by_hash:
        lv = lv.select("column_name", F.xxhash64("value").alias("h1"), F.hash("value").alias("h2"))
    return lv.distinct().groupBy("column_name").agg(F.count("*").alias("n_distinct"))


def value_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, mode, freq)``: most frequent value, smallest on a tie.

    Two-phase: counts per (column, value), then ``min(struct(-count, value))``
    per column, a bounded aggregate (no value map in one task).  Numeric
    columns are compared numerically, strings by code point.
    """
    frames = [df.sparkSession.createDataFrame([], "column_name string, mode string, freq long")]
    numeric = set(numeric_columns(df))
    num = [c for c in columns if c in numeric]
    txt = [c for c in columns if c not in numeric]
    if num:
        lv = long_values(df, num)
        frames.append(lv.groupBy("column_name", "value").count()
                      .groupBy("column_name")
                      .agg(F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v"))).alias("m"))
                      .select("column_name", F.col("m.v").cast("string").alias("mode"),
                              (-F.col("m.nc")).alias("freq")))
    if txt:
        frames.append(value_counts(df, txt).groupBy("column_name")
                      .agg(F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v"))).alias("m"))
                      .select("column_name", F.col("m.v").alias("mode"), (-F.col("m.nc")).alias("freq")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def string_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """J8 string describe: ``(column_name, count, unique, top, freq)``."""
    columns = list(columns) if columns is not None else string_columns(df)
    vc = value_counts(df, columns)
    per = vc.groupBy("column_name").agg(
        F.sum("count").alias("count"), F.count("*").alias("unique"),
        F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v"))).alias("m"))
    return per.select("column_name", F.col("count").cast("long").alias("count"), "unique",
                      F.col("m.v").alias("top"), (-F.col("m.nc")).alias("freq"))


# ---------------------------------------------------------------- J5

def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """``(column_name, bin, lower, upper, count)`` over ``bins`` equal-width bins.

    ``bin = min(floor((x - min) / (max - min) * bins), bins - 1)``; a constant
    column puts everything in bin 0.  Empty bins give no row.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, lower double, upper double, count long")
    lv = long_values(df, columns)
    rng = lv.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # bounded: one row per column
    span = F.col("hi") - F.col("lo")
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.when(span != 0, span)) * bins),
                           F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = (lv.join(F.broadcast(rng), "column_name").withColumn("bin", b)
               .groupBy("column_name", "bin", "lo", "hi").agg(F.count("*").alias("count")))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("column_name", "bin",
                          (F.col("lo") + width * F.col("bin")).alias("lower"),
                          (F.col("lo") + width * (F.col("bin") + 1)).alias("upper"), "count")


def distribution(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Labelled bins ``(bin, label, count)`` of one numeric column; the label is
    ``"<lower> - <upper>"`` with bounds rounded to 2 decimals."""
    h = histogram(df, [column], bins)
    label = F.concat(F.round("lower", 2).cast("string"), F.lit(" - "), F.round("upper", 2).cast("string"))
    return h.select("bin", label.alias("label"), "count")


def binned_scatter(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """B8 at scale: 2-D binned counts ``(x_bin, y_bin, count)`` instead of raw points.

    The two ranges are one aggregate row (four numbers) read on the driver.
    """
    cols = df.select(clean_double(F.col(x)).alias("x"), clean_double(F.col(y)).alias("y")).dropna()
    r = cols.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def bucket(v: str, lo, hi) -> Column:
        if lo is None or hi is None or hi == lo:
            return F.lit(0)
        return F.least(F.floor((F.col(v) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")

    return (cols.select(bucket("x", r[0], r[1]).alias("x_bin"), bucket("y", r[2], r[3]).alias("y_bin"))
            .groupBy("x_bin", "y_bin").agg(F.count("*").alias("count")))


# ---------------------------------------------------------------- J6, J7

#: Sums of pairs that a worker holds at once, and numbers of a slice of rows.
CORRELATION_BYTES = 256 << 20
SLICE_NUMBERS = 4 << 20


def _pair_sums(means: Sequence[float], lo: int, hi: int):
    """A partition's sums for the pairs of columns lo..hi - 1 with themselves and all behind them: a row for each pair a <= b."""
    k = len(means)

    def fold(batches):
        total = np.zeros((6, hi - lo, k - lo))
        for batch in batches:
            step = max(1, SLICE_NUMBERS // k)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.empty((part.num_rows, k - lo))
                for i in range(lo, k):
                    x[:, i - lo] = part.column(i).to_numpy(zero_copy_only=False)
                x -= means[lo:]
                m = 1.0 - np.isnan(x)
                np.nan_to_num(x, copy=False)
                xa, ma = x[:, :hi - lo], m[:, :hi - lo]
                for i, (left, right) in enumerate(((ma, m), (xa, m), (ma, x), (xa * xa, m), (ma, x * x), (xa, x))):
                    total[i] += left.T @ right
        for a in range(hi - lo):  # a row of the matrix at a time
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k - lo - a, lo + a)), pa.array(np.arange(lo + a, k)),
                                              *[pa.array(t[a, a:]) for t in total]], ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])
    return fold


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_a, column_b, corr)`` Pearson, pairwise-complete, all ordered pairs.

    One scan finds the means, a second one folds each partition's rows, centred, into
    columns x columns sums (rows, values, squares and products where both are present),
    which are then added up, with gaps or without.  A worker holds at most ``CORRELATION_BYTES``
    of sums (2,300 columns); wider tables take a scan for each tile of columns that fits.  Undefined values (fewer than two rows, or no spread) are NULL.  Fewer than
    two numeric columns give an empty frame.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    schema = "column_a string, column_b string, corr double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    k = len(columns)
    values = df.select(*[clean_double(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    means: list[float] = []
    for at in range(0, k, 50):  # one mean for each column
        means += [m or 0.0 for m in values.agg(*[F.avg(f"c{i}") for i in range(at, min(k, at + 50))]).first()]

    fields = ["n", "sa", "sb", "saa", "sbb", "sab"]
    sums = None
    for lo in range(0, k, step := max(1, CORRELATION_BYTES // (48 * k))):
        part = values.mapInArrow(_pair_sums(means, lo, min(k, lo + step)), "a long, b long, " + ", ".join(f"{f} double" for f in fields)) \
            .groupBy("a", "b").agg(*[F.sum(f).alias(f) for f in fields])
        sums = part if sums is None else sums.unionByName(part)
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    # no spread: what is left of the squares is rounding (of the centred values, or of the mean itself)
    spread_a = va > F.greatest(F.col("saa") * 1e-13, floor_of(means, "a") * F.col("n"))
    spread_b = vb > F.greatest(F.col("sbb") * 1e-13, floor_of(means, "b") * F.col("n"))
    corr = F.when((F.col("n") >= 2) & spread_a & spread_b,
                  F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(va * vb))))
    names = F.array(*[F.lit(c) for c in columns])
    pair = sums.select(F.element_at(names, (F.col("a") + 1).cast("int")).alias("x"),
                       F.element_at(names, (F.col("b") + 1).cast("int")).alias("y"), corr.alias("corr"))
    both = F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))
    return pair.select(F.explode(F.array_distinct(both)).alias("ab"), "corr") \
        .select(F.col("ab.a").alias("column_a"), F.col("ab.b").alias("column_b"), "corr")


def floor_of(means: Sequence[float], index: str) -> Column:
    """Square of the rounding error of a column's values around its mean."""
    return F.element_at(F.array(*[F.lit((abs(m) * 1e-15) ** 2) for m in means]), (F.col(index) + 1).cast("int"))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, corr, rank)``: each numeric feature against the target, rank by |corr| desc."""
    columns = [c for c in (columns if columns is not None else numeric_columns(df)) if c != target]
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, corr double, rank int")
    y = clean_double(F.col(target))
    per = {c: F.struct(F.lit(c).alias("feature"), safe_corr(clean_double(F.col(c)), y).alias("corr"))
           for c in columns}
    out = _wide_to_long(df, per, width=10).drop("column_name")
    w = Window.orderBy(F.desc_nulls_last(F.abs("corr")), F.asc("feature"))
    # one row per feature: a single ordered window over a bounded frame
    return out.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------- J9, J10, J14, J15, B7

def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form ``(a, b, count)``, missing excluded."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count("*").alias("count")))


def box_stats(df: DataFrame, category: str, value: str) -> DataFrame:
    """Per category ``count, min, q1, median, q3, max`` of a numeric column (exact)."""
    base = df.where(F.col(category).isNotNull())
    q = exact_quantiles(base, [value], [0.25, 0.5, 0.75], group_cols=[category])
    qw = (q.groupBy(category).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
          .select(category, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"),
                  F.col("`0.75`").alias("q3")))
    x = clean_double(F.col(value))
    mm = base.groupBy(category).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"))
    return mm.join(qw, category, "left").select(category, "count", "min", "q1", "median", "q3", "max")


def aggregate(df: DataFrame, group_by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Free aggregate question, e.g. ``{"avg_balance": F.avg("c_acctbal")}`` by segment."""
    cols = [m.alias(name) for name, m in measures.items()]
    return df.groupBy(*group_by).agg(*cols) if group_by else df.agg(*cols)


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Row filter from a question, as a column expression or SQL predicate."""
    return df.where(condition)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """``(label, count, share)`` with share of all non-missing labels."""
    present = df.where(F.col(label).isNotNull())
    total = present.count()  # one number, so that a label with very many values needs no common window
    return present.groupBy(label).agg(F.count("*").alias("count")) \
        .withColumn("share", F.col("count") / F.lit(float(total or 1)))
