"""Helpers shared by the text operators: materialised tables, row keys, components."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.session import LARGE_ROWS, ensure_checkpoint_dir

# ASCII white space that separates words in every operator of this package.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def saved(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor costs only the stages after this point) and
    freezes generated ids.  The files go when the application ends.  The driver's
    garbage is collected afterwards, so that Spark drops the shuffle files of the
    steps that fed this table.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path.toString())
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path.toString())


def bucketed(df: DataFrame, key: str, tag: str, dealt: bool = False) -> DataFrame:
    """Like ``saved``, but bucketed by ``key``: later joins on it leave these rows where they are.

    ``dealt``: equal keys already stand in one task, which writes its own buckets (of large rows) without another shuffle.

    The files are an unmanaged table in the checkpoint folder; its catalog entry is only
    needed while the plan is resolved and goes at once.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    name, parts = f"llm_{tag}_{uuid.uuid4().hex}", shuffle_parts(spark)
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    # zstd: these tables stay to the end of an operator, and texts take a good deal less room than by snappy
    (df if dealt else df.repartition(parts, key)).write.options(**(LARGE_ROWS if dealt else {})).option("path", path.toString()).option("compression", "zstd").bucketBy(parts, key).sortBy(key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    jvm.System.gc()
    return table


def dropped(df: DataFrame) -> None:
    """Delete a table that ``saved`` or ``bucketed`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    starts = {f: max(f.rfind("/llm-"), f.rfind("/llm_")) for f in df.inputFiles()}
    for name in {f[: f.index("/", at + 1)] for f, at in starts.items() if at >= 0}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: str = "text") -> Column:
    """The text column; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str, folds: int) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2; a NULL id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 2, F.lit(False))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Alternating large-star and small-star steps: every round is two aggregations,
    the number of rounds grows with the logarithm of the longest path, and edges
    never outnumber those of the input.  A node with very many neighbours meets
    them in partial aggregates and in joins that Spark can split, never in a list.
    Nodes without edges are not returned.
    """
    cur = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                .where("u is not null and v is not null and u != v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        new = saved(small, "edges")
        # a fixed point is a set of stars: as many edges and the same sums twice in a row
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(cur)
        cur = new
        if mark == before:
            return cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component") \
                .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError("components did not settle")


def with_schema(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """Schema of ``df`` followed by the given (name, type) fields."""
    extra = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    return T.StructType([*df.schema.fields, *extra.fields])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text's UTF-8 bytes (NULL counts as empty), lowercase hex."""
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many ``_`` behind it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, stays: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose (key, text) is in ``stays`` (key, text_sha256, n_same), each once.

    n_same says how many equal (key, text) rows ``docs`` holds; only those with
    several are deduplicated, so that other rows are not shuffled again.  Columns of
    ``docs`` may have any names.
    """
    k, s, n = unused(docs, "k_", "s_", "n_")
    right = stays.select(F.col(key).alias(k), F.col("text_sha256").alias(s), F.col("n_same").alias(n))
    joined = docs.join(right, F.col(key).eqNullSafe(F.col(k)) & (text_digest(text) == F.col(s)))
    once = joined.where(F.col(n) == 1).select(*docs.columns)
    if right.where(F.col(n) > 1).isEmpty():
        return once
    return once.unionByName(joined.where(F.col(n) > 1).dropDuplicates([k, s]).select(*docs.columns))


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Compressed bytes of an array, plane by plane; of ordered integers the differences are kept."""
    if ordered and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    """The array that ``pack`` was given."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)
    return np.cumsum(values, dtype=kind) if ordered else values
