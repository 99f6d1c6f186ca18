"""Semantic type inference (C1, C3, C5, C6) and numeric coercion (C4).

One aggregate job counts the values of every text column by their date shape, and how many of them
look numeric: one row per column and shape, so that the code run on a value is the same short code for
any number of columns.  Only columns all of whose values have such shapes are read again, for the
few formats that fit all of them.  Where types alone are
wanted, only text columns that are neither numbers nor dates are left, and only their
hashed values are shuffled for distinct counts (see ``profile.distinct_counts``).  The classification is a
``CASE`` over that tidy frame.

Decisions (see the semantics ledger in SURVEY): numeric physical types and
booleans are ``numeric``; a string column is ``numeric`` when every
non-missing value is numeric-looking text (full scan, at least one digit,
skipped when fewer than ``min(10, n)`` values are present); otherwise
``datetime`` when one format reads every non-missing value; timestamp and
date types are ``datetime``; the rest is ``categorical`` when
``n_distinct < min(50, 0.5 n)`` and ``text`` otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.dates import DATE_FORMATS, ISO, count_dates, formats_of, with_shapes
from loam.functions.numeric_text import coerce_numeric, looks_numeric
from loam.functions.schema import NUMERIC_TYPES, DATETIME_TYPES, flat_columns
from loam.functions.stats import nan_to_null
from loam.operators.profile import _wide_to_long, distinct_counts
from loam.sources.readers import quoted

CATEGORICAL_MAX_DISTINCT = 50
CATEGORICAL_MAX_SHARE = 0.5
NUMERIC_MIN_SAMPLE = 10
#: Counts of formats in one pass; the code of many more is too long to be compiled well.
PASS_FORMATS = 18


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, (NUMERIC_TYPES)) or isinstance(dt, T.BooleanType):
        return "number"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "string"


def type_evidence(df: DataFrame, columns: list[str] | None = None, count_all: bool = True) -> DataFrame:
    """``(column_name, kind, n_rows, non_null, numeric_like, datetime_like, date_format, n_distinct)``.

    datetime_like is the best count of any one date format, which date_format names (0 where
    some value has no date's shape).  n_distinct is counted by hashed values; without ``count_all``
    only for text that is neither numeric nor a date (0 elsewhere), which is all that types depend on.
    """
    columns = list(columns) if columns is not None else flat_columns(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in columns if _kind(fields[c]) == "string"]
    per = {}
    for c in columns:
        kind = _kind(fields[c])
        col = F.col(quoted(c))
        present = nan_to_null(col) if isinstance(fields[c], (T.DoubleType, T.FloatType)) else col
        if c not in texts:
            per[c] = F.struct(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count(present).alias("non_null"),
                              F.lit(0).cast("long").alias("numeric_like"))
    # one row for each column
    found = {r["column_name"]: r.asDict() for r in _wide_to_long(df, per, width=4).collect()} if per else {}
    seen = _shape_counts(df, texts)
    for c in texts:
        got = seen[c]
        found[c] = {"column_name": c, "kind": "string", **{k: sum(r[k] for r in got) for k in ("n_rows", "non_null", "numeric_like")}}
    rows = [found[c] for c in columns]
    shaped = {c: sum(r["non_null"] for r in got if r["shape"] is not None) for c, got in seen.items()}
    dated = [c for c in texts if 0 < shaped[c] == found[c]["non_null"] and not _all_numeric(found[c])]
    best = _read_most(df, {c: _shapes_of(seen[c]) for c in dated})
    for r in rows:
        r["date_format"], r["datetime_like"] = best.get(r["column_name"], (None, 0))
    open_text = columns if count_all else [r["column_name"] for r in rows if r["kind"] == "string" and r["non_null"]
                 and r["datetime_like"] < r["non_null"] and not _all_numeric(r)]
    distinct = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, open_text).collect()} if open_text else {}
    return df.sparkSession.createDataFrame(
        [(r["column_name"], r["kind"], r["n_rows"], r["non_null"], r["numeric_like"], r["datetime_like"], r["date_format"],
          distinct.get(r["column_name"], 0)) for r in rows],
        "column_name string, kind string, n_rows long, non_null long, numeric_like long, datetime_like long, "
        "date_format string, n_distinct long")


def _all_numeric(r: dict) -> bool:
    return r["non_null"] >= min(NUMERIC_MIN_SAMPLE, r["n_rows"]) and r["numeric_like"] == r["non_null"]


def _shape_counts(df: DataFrame, columns: list[str]) -> dict[str, list[dict]]:
    """Per text column its values by date shape (one row for all that have none): ``shape, n_rows, non_null, numeric_like``.

    There are at most as many shapes as the formats allow.  Whether a text looks numeric shows in its shape, if nothing
    was cut off the text.
    """
    out: dict[str, list[dict]] = {c: [] for c in columns}
    if not columns:
        return out
    values = with_shapes(df.select(F.posexplode(F.array(*[F.col(quoted(c)).cast("string") for c in columns])).alias("at", "text")), "text")
    told = F.col("shape").isNotNull() & F.col("bare")
    counts = values.withColumn("told", F.coalesce(told, F.lit(False))).groupBy("at", "shape", "told").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("non_null"),
        F.count_if(~F.col("told") & looks_numeric(F.col("text"))).alias("numeric_like"))
    counts = counts.withColumn("numeric_like", F.when(F.col("told") & looks_numeric(F.col("shape")), F.col("n_rows")).otherwise(F.col("numeric_like")))
    for r in counts.collect():
        out[columns[r["at"]]].append(r.asDict())
    return out


def _shapes_of(counts: list[dict]) -> list[str]:
    return sorted({r["shape"] for r in counts if r["shape"] is not None})


def best_formats(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, int]]:
    """Of each text column the format that reads most values (the first of several) and how many it reads.

    Two aggregates: the shapes of each column, of which there are at most as many as the formats
    allow, and counts for the formats that fit all of them (for most, where none does).
    """
    return _read_most(df, {c: _shapes_of(got) for c, got in _shape_counts(df, columns).items()})


def _read_most(df: DataFrame, shapes: dict[str, list[str]]) -> dict[str, tuple[str, int]]:
    """``best_formats`` of columns whose shapes are known."""
    tried = {c: formats_of(seen) or sorted({f for s in seen for f in formats_of([s])}, key=DATE_FORMATS.index)
             for c, seen in shapes.items() if seen}
    pairs = [(c, f) for c, fs in tried.items() for f in fs]
    counts = []
    for at in range(0, len(pairs), PASS_FORMATS):
        some = pairs[at: at + PASS_FORMATS]
        counts += df.agg(*[count_dates(F.col(quoted(c)), f).alias(f"n{i}") for i, (c, f) in enumerate(some)]).first()
    best: dict[str, tuple[str, int]] = {}
    for (c, f), n in zip(pairs, counts):
        if n and n > best.get(c, (f, 0))[1]:
            best[c] = (f, n)
    return best


def date_formats(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The format of each text column of dates: the first that reads all values, else the one that reads most."""
    best = best_formats(df, columns)
    return {c: best.get(c, (ISO, 0))[0] for c in columns}


def detect_column_types(df: DataFrame, columns: list[str] | None = None, count_all: bool = True) -> DataFrame:
    """``(column_name, semantic_type)`` plus the evidence behind it."""
    ev = type_evidence(df, columns, count_all)
    n = F.col("n_rows")
    nn = F.col("non_null")
    enough = nn >= F.least(F.lit(NUMERIC_MIN_SAMPLE), n)
    sem = (F.when(F.col("kind") == "number", "numeric")
           .when((F.col("kind") == "string") & (nn > 0) & enough & (F.col("numeric_like") == nn), "numeric")
           .when((F.col("kind") == "string") & (nn > 0) & (F.col("datetime_like") == nn), "datetime")
           .when(F.col("kind") == "datetime", "datetime")
           .when(F.col("n_distinct") < F.least(F.lit(CATEGORICAL_MAX_DISTINCT).cast("double"),
                                               n * CATEGORICAL_MAX_SHARE), "categorical")
           .otherwise("text"))
    return ev.withColumn("semantic_type", sem)


def column_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """C1 as an ordered ``{column: type}`` dict (one row per column reaches the driver)."""
    return column_types_with_evidence(df, columns)[0]


def column_types_with_evidence(df: DataFrame, columns: list[str] | None = None):
    """C1 plus the evidence rows (one per column): ``({column: type}, {column: row dict})``."""
    rows = {r["column_name"]: r.asDict() for r in detect_column_types(df, columns, count_all=False).collect()}
    order = [c for c in (columns if columns is not None else flat_columns(df)) if c in rows]
    return {c: rows[c]["semantic_type"] for c in order}, {c: rows[c] for c in order}


def format_numeric_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """C4: string columns typed ``numeric`` are stripped to digits/``.``/``-`` and parsed."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for c in df.columns:
        if types.get(c) == "numeric" and isinstance(fields[c], T.StringType):
            cols.append(coerce_numeric(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def eager_coercion_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C5 (legacy rule): ``numeric`` if any value parses as a number, else ``datetime``
    if any parses as a timestamp, else ``string``; one aggregate."""
    columns = list(columns) if columns is not None else flat_columns(df)
    per = {c: F.struct(F.max(F.col(c).cast("string").try_cast("double").isNotNull()).alias("any_num"),
                       F.max(F.try_to_timestamp(F.col(c).cast("string")).isNotNull()).alias("any_dt"))
           for c in columns}
    ev = _wide_to_long(df, per)
    return ev.select("column_name",
                     F.when(F.col("any_num"), "numeric").when(F.col("any_dt"), "datetime")
                     .otherwise("string").alias("coerced_type"))


def apply_eager_coercion(df: DataFrame, coerced: dict[str, str]) -> DataFrame:
    """C5 apply: cast per the decided type with ``try_cast`` (bad values become NULL)."""
    cols = []
    for c in df.columns:
        t = coerced.get(c)
        if t == "numeric":
            cols.append(F.col(c).cast("string").try_cast("double").alias(c))
        elif t == "datetime":
            cols.append(F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz").alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    return df.select(*cols)


def detect_problem_type(df: DataFrame, target: str) -> DataFrame:
    """``regression`` when every target value parses as a number and
    ``n_distinct >= min(50, 0.5 n)``; otherwise ``classification``.

    Two-level aggregate: value counts of the target (partial aggregation
    first), then totals over those counts.
    """
    t = F.col(target)
    vc = df.groupBy(t.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    parses = F.col("v").isNotNull() & F.col("v").cast("string").try_cast("double").isNotNull()
    tot = vc.agg(F.sum("cnt").alias("n"), F.count("v").alias("n_distinct"),
                 F.sum(F.when(parses, 0).otherwise(F.col("cnt"))).alias("bad"))
    kind = F.when((F.col("bad") == 0) & (F.col("n_distinct") >= F.least(
        F.lit(CATEGORICAL_MAX_DISTINCT).cast("double"), F.col("n") * CATEGORICAL_MAX_SHARE)),
        "regression").otherwise("classification")
    return tot.select(F.lit(target).alias("target"), F.col("n").cast("long").alias("n"),
                      "n_distinct", kind.alias("problem_type"))
