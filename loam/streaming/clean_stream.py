"""Apply a batch-fitted cleaning plan to a Structured Streaming source.

``CleaningPlan.transform`` is row-wise after fitting: renames, casts, literal
fills, literal outlier bounds, whitespace cleanup, one-hot projections, a
stream-static join to the (checkpointed) label-code tables and date parts.
All of that is valid on a stream.  Duplicate removal is not applied to
streams: without an event-time watermark its state would grow without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loam.plans.cleaning import CleaningPlan
from loam.sources.sinks import new_output_path


def clean_stream(plan: CleaningPlan, stream: DataFrame) -> DataFrame:
    """The fitted plan on a streaming frame (no de-duplication)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return plan.transform(stream, dedupe=False)


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """File stream over a folder of Parquet files (schema given, no inference)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(cleaned: DataFrame, out_path: str | None = None, checkpoint: str | None = None) -> str:
    """Process everything available now into a Parquet sink; returns the sink path.

    The checkpoint location is in the shared output folder, so a restarted
    query resumes where it stopped.
    """
    spark = cleaned.sparkSession
    out_path = out_path or new_output_path(spark, "stream-out")
    checkpoint = checkpoint or new_output_path(spark, "stream-ckpt")
    q = (cleaned.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
