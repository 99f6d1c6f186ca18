"""Session helpers.

``get_spark`` builds a local session for tests and the bench; on a cluster
the caller passes its own session and these helpers only read settings.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on: UTC session time zone (timestamps compare
# equal to the oracle's naive timestamps) and adaptive execution.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "loam") -> SparkSession:
    """Local session for tests and benchmarks."""
    master = master or os.environ.get("LOAM_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LOAM_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    used as is.  Only when nothing is configured (local tests) a scratch folder
    is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loam-ckpt-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint, with a folder made sure of.

    Spark deletes its files once the frame is garbage, where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of megabytes: row groups end where they should, not after a hundred rows.
LARGE_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, large_rows: bool = False) -> tuple[DataFrame, str]:
    """A Parquet copy in the checkpoint folder and its path, for ``remove`` when it is no longer read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/loam-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
