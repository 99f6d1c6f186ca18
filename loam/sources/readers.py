"""Sources (A1-A4, A8-A10, A12): load a table, normalise missing values, peek."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.sources.records import CSV, JSON_ARRAY, records

# Fixed value: file extensions the loader accepts (lower-cased).
SUPPORTED_EXTENSIONS = (".csv", ".json", ".parquet")

# CSV fields that mean "missing" unless the caller names others.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
INTEGER_FIELD = r"^[ \t]*[+-]?[0-9]{1,18}[ \t]*\z"
NUMBER_FIELD = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*\z"
BOOLEAN_FIELD = r"^(true|True|TRUE|false|False|FALSE)\z"


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating columns (optional: the operators already treat
    NaN as missing, and this projection would stop filter pushdown on those columns)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
         infer_schema: bool = True, all_strings: bool = False, nan_to_null: bool = False,
         multi_line: bool = False, missing: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """A1-A3: read by lower-cased extension; other extensions raise ``ValueError``.

    CSV has a header row, doubled quotes inside quoted fields, and keeps the blanks
    around a field.  Fields equal to one of ``missing`` are missing, before types are
    inferred: a column is bigint, double or boolean if all its other fields are, else
    text (dates are told by C1, not here).  Inference is one aggregate pass.
    ``multi_line`` allows line breaks inside quotes (records end with LF or CRLF).  JSON may be
    JSON lines or one array of records, of which elements that are no objects are left out.
    Both are split like other text (see ``loam.sources.records``).  ``all_strings`` (A4) reads every column as text.  Other scans are returned
    as they are, so projections and filters reach the reader; every operator treats
    NaN as missing itself (``nan_to_null`` rewrites floating columns up front).
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUPPORTED_EXTENSIONS:
        raise ValueError(f"cannot load {ext or 'a path without extension'}; known: {', '.join(SUPPORTED_EXTENSIONS)}")
    if ext == ".csv":
        df = _csv_fields(spark, path, multi_line, missing)
        if schema is not None:
            df = _cast_fields(df, schema)
        elif infer_schema and not all_strings:
            df = _infer_fields(df)
    elif ext == ".json":
        start = _json_start(spark, path)
        if start.startswith("[{"):
            df = _json_records(spark, path, schema, all_strings)
        else:
            reader = spark.read.option("multiLine", start.startswith("["))
            if schema is not None:
                reader = reader.schema(schema)
            elif all_strings:
                reader = reader.option("primitivesAsString", True)
            df = reader.json(path)
    else:
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if all_strings:
        df = as_strings(df)
    return normalize_missing(df) if nan_to_null else df


_CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv_fields(spark: SparkSession, path: str, multi_line: bool, missing: Sequence[str]) -> DataFrame:
    """Every field as text, missing tokens as NULL."""
    df = spark.read.options(**_CSV_OPTIONS).option("header", True).option("multiLine", multi_line).csv(path)
    if multi_line:  # only the header is read that way
        places = [f"c{i}" for i in range(len(df.columns))]
        fields = F.from_csv("value", ", ".join(f"{p} string" for p in places), _CSV_OPTIONS | {"multiLine": "true"})
        df = records(spark, path, CSV).where("not first").select(fields.alias("f")).select("f.*").toDF(*df.columns)
    cols = [F.col(quoted(c)) for c in df.columns]
    return df.select(*[F.when(~v.isin(*missing), v).alias(c) if missing else v for c, v in zip(df.columns, cols)])


def _json_records(spark: SparkSession, path: str, schema: T.StructType | str | None, all_strings: bool) -> DataFrame:
    """The objects of an array document, parsed one by one; their schema is inferred from all of them."""
    texts = records(spark, path, JSON_ARRAY).select("value")
    if schema is None:
        reader = spark.read.option("primitivesAsString", all_strings)
        schema = reader.json(texts.rdd.map(lambda r: r[0])).schema
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return texts.select(F.from_json("value", schema).alias("r")).select("r.*")


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def _infer_fields(df: DataFrame) -> DataFrame:
    """bigint, double or boolean where every present field is one; an empty column stays text."""
    kinds = (("bigint", INTEGER_FIELD), ("double", NUMBER_FIELD), ("boolean", BOOLEAN_FIELD))
    out = list(df.columns)
    for at in range(0, len(out), 25):  # bounded expressions per pass
        some = out[at: at + 25]
        row = df.agg(*[x for i, c in enumerate(some) for x in (
            F.count(F.col(quoted(c))).alias(f"n{i}"),
            *[F.count_if(F.col(quoted(c)).rlike(pattern)).alias(f"{kind}{i}") for kind, pattern in kinds])]).first()
        for i, c in enumerate(some):
            kind = next((k for k, _ in kinds if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), None)
            out[at + i] = F.trim(F.col(quoted(c))).cast(kind).alias(c) if kind else F.col(quoted(c))
    return df.select(*out)


def _cast_fields(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Fields cast to a given schema by position; what doesn't parse is missing."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[F.col(quoted(c)).try_cast(f.dataType).alias(f.name) for c, f in zip(df.columns, kinds.fields)])


def _json_start(spark: SparkSession, path: str) -> str:
    """``[{`` where a JSON source starts as an array of objects, ``[`` with something else behind it for other arrays.

    Read through Spark, so any file system the cluster mounts works; of what stands before the first
    brace two characters that are not blank reach the driver.
    """
    before = F.regexp_replace(F.substring("value", 1, 10_000), r"\s+", "")
    first = spark.read.option("lineSep", "{").text(path).select(F.substring(before, 1, 2).alias("v")).limit(1).collect()
    start = first[0]["v"] if first else ""
    return "[{" if start == "[" else start


def as_strings(df: DataFrame) -> DataFrame:
    """A4: every column cast to string (missing stays missing)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables: ``<sf_dir>/<name>.parquet`` (plain scan: filters and
    column pruning push down to Parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """A8/A12 head: first ``n`` rows by a key (a key makes it deterministic)."""
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """A12 tail: last ``n`` rows by a key."""
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n)


def sample_rows(df: DataFrame, key: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key; same rows under any partitioning.

    ``orderBy(...).limit(n)`` plans as a per-partition top-n, so no task holds
    more than ``n`` rows.
    """
    from loam.functions.hashing import seeded_hash52
    return df.withColumn("_h", seeded_hash52(key, seed)).orderBy("_h", *key).limit(n).drop("_h")
