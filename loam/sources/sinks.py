"""Sinks (A5-A7, A11): snapshots, cleaned tables, tidy results, model metadata.

Paths default to a folder under the session's shared output root
(``loam.output.dir``, else beside ``spark.checkpoint.dir``), never a
machine-local temporary folder.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import ensure_checkpoint_dir


def output_root(spark: SparkSession) -> str:
    configured = spark.conf.get("loam.output.dir", None)
    if configured:
        return configured.rstrip("/")
    return ensure_checkpoint_dir(spark).rstrip("/") + "/loam-output"


def new_output_path(spark: SparkSession, name: str) -> str:
    return f"{output_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_snapshot(df: DataFrame, path: str | None = None) -> str:
    """A5: Parquet snapshot of the source; reading it back restores the input."""
    path = path or new_output_path(df.sparkSession, "snapshot")
    df.write.mode("overwrite").parquet(path)
    return path


def save_cleaned(df: DataFrame, path: str | None = None, fmt: str = "csv") -> str:
    """Cleaned table as CSV with a header, Parquet, JSON lines, or JSON arrays (one document in each file).

    CSV doubles quotes inside fields and keeps blanks and line breaks (to be read with
    ``multi_line``); missing values are empty fields.
    """
    path = path or new_output_path(df.sparkSession, "cleaned")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        (writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "json_array":
        rows = df.select(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]),
                                   {"ignoreNullFields": "false"}).alias("value"))
        rows.mapInArrow(_array_lines, "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown output format: {fmt}")
    return path


def _array_lines(batches):
    """The records of a partition as the lines of one JSON array."""
    first = True
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + t for i, t in enumerate(texts)])], ["value"])
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])


def save_results(frames: dict[str, DataFrame], path: str | None = None) -> str:
    """Every tidy result frame as JSON lines under ``<path>/<name>``."""
    if not frames:
        raise ValueError("nothing to save")
    spark = next(iter(frames.values())).sparkSession
    path = path or new_output_path(spark, "analysis")
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
    return path
