"""Categorical encoding (H1-H4) and the irrelevant-column rule.

Label codes are the 0-based rank of each distinct value in code-point order
(UTF-8 byte order, which equals code-point order).  The rank is computed
without a single-partition window: distinct values are range-partitioned,
numbered inside each partition, and shifted by the sizes of the earlier
partitions (one row per partition reaches that step).  The value -> code map
is joined back; it is broadcast only while its labels and codes together take at most
``BROADCAST_MAX_BYTES``, summed when the codes are made.  In the shuffle join that
takes over beyond it, missing values do not meet in one partition: their code is looked
up once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import safe_identifier
from loam.operators.profile import distinct_counts, value_counts
from loam.session import materialise

NULL_LABEL = "nan"
ONEHOT_THRESHOLD = 10
BROADCAST_MAX_BYTES = 16 << 20


def _as_label(c: str, null_label: str | None):
    col = F.col(c).cast("string")
    return F.coalesce(col, F.lit(null_label)) if null_label is not None else col


def label_codes(df: DataFrame, column: str, null_label: str | None = NULL_LABEL,
                partitions: int | None = None) -> DataFrame:
    """``(value, code)``: 0-based rank of each distinct label in code-point order."""
    values = df.select(_as_label(column, null_label).alias("value")).where(F.col("value").isNotNull()).distinct()
    return rank_values(values, partitions)


def rank_values(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(value, code)`` for a frame of distinct strings ``value``."""
    n_parts = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # materialised once: both branches below must see the same partition ids
    ranged = materialise(values.repartitionByRange(n_parts, "value").withColumn("pid", F.spark_partition_id()))
    local = ranged.withColumn("i", F.row_number().over(Window.partitionBy("pid").orderBy("value")) - 1)
    sizes = ranged.groupBy("pid").agg(F.count("*").alias("size"))
    # one row per partition: a tiny ordered window
    offsets = sizes.withColumn("offset", F.coalesce(
        F.sum("size").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offsets.select("pid", "offset")), "pid")
            .select("value", (F.col("i") + F.col("offset")).cast("long").alias("code")))


@dataclass
class Encoding:
    column: str
    method: str                      # "label" or "onehot"
    output: list[str]
    categories: list[str] = field(default_factory=list)   # one-hot values, sorted
    codes: DataFrame | None = None                      # label map
    n_codes: int = 0
    code_bytes: int = 0                                 # of all labels and codes


@dataclass
class EncodingPlan:
    encodings: list[Encoding]
    target: str | None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for e in self.encodings:
            out = apply_encoding(out, e)
        return out

    def encoded_columns(self) -> dict[str, list[str]]:
        return {e.column: e.output for e in self.encodings}


def save_encodings(plan: EncodingPlan | None, path: str) -> dict | None:
    """What JSON can keep of a plan; the label codes are written as Parquet under ``path``."""
    if plan is None:
        return None
    for i, e in enumerate(plan.encodings):
        if e.codes is not None:
            e.codes.write.mode("overwrite").parquet(f"{path}/{i}")
    return {"target": plan.target, "list": [
        {"column": e.column, "method": e.method, "output": e.output, "categories": e.categories, "n_codes": e.n_codes,
         "code_bytes": e.code_bytes} for e in plan.encodings]}


def load_encodings(spark: SparkSession, meta: dict | None, path: str) -> EncodingPlan | None:
    if meta is None:
        return None
    return EncodingPlan([Encoding(**e, codes=spark.read.parquet(f"{path}/{i}") if e["method"] == "label" else None)
                         for i, e in enumerate(meta["list"])], meta["target"])


def _label_encoding(codes: DataFrame, column: str) -> Encoding:
    """Encoding with the size of its code table."""
    size = codes.agg(F.count("*"), F.sum(F.octet_length("value") + 16)).first()
    return Encoding(column, "label", [f"{column}_encoded"], codes=codes, n_codes=size[0], code_bytes=size[1] or 0)


def fit_label(df: DataFrame, column: str, null_label: str | None = NULL_LABEL) -> Encoding:
    return _label_encoding(materialise(label_codes(df, column, null_label)), column)


def _label_from_counts(vc: DataFrame, column: str, has_null: bool,
                       null_label: str | None = NULL_LABEL) -> Encoding:
    """Label codes from already distinct ``(column_name, value)`` counts (no new shuffle of
    the data); the missing label joins the values when the column has missing values.
    The codes derive from a checkpointed frame, so they are not materialised again."""
    values = vc.where(F.col("column_name") == column).select("value")
    if has_null and null_label is not None:
        extra = vc.sparkSession.createDataFrame([(null_label,)], "value string")
        values = values.where(F.col("value") != null_label).unionByName(extra)
    return _label_encoding(rank_values(values), column)


def _onehot_names(column: str, cats: list[str], existing: set[str]) -> list[str]:
    names = []
    for v in cats:
        base = safe_identifier(f"{column}_{v}")
        name, k = base, 1
        while name in existing:
            k += 1
            name = f"{base}_{k}"
        existing.add(name)
        names.append(name)
    return names


def apply_encoding(df: DataFrame, e: Encoding, null_label: str | None = NULL_LABEL) -> DataFrame:
    src = F.col("`" + e.column + "`").cast("string")
    if e.method == "onehot":
        # one projection, whatever the number of values
        return df.select("*", *[F.coalesce(src == F.lit(v), F.lit(False)).alias(name)
                                for name, v in zip(e.output, e.categories)])
    out = e.output[0]
    if e.code_bytes <= BROADCAST_MAX_BYTES:
        codes = F.broadcast(e.codes.withColumnRenamed("value", "_lbl").withColumnRenamed("code", out))
        return df.withColumn("_lbl", _as_label(e.column, null_label)).join(codes, "_lbl", "left").drop("_lbl")
    codes = e.codes.withColumnRenamed("value", "_lbl").withColumnRenamed("code", "_code")
    missing = None
    if null_label is not None:
        row = e.codes.where(F.col("value") == null_label).select("code").first()
        missing = row["code"] if row else None
    # a NULL key meets no partner, and Spark spreads such rows of a left join
    joined = df.withColumn("_lbl", src).join(codes, "_lbl", "left")
    return joined.withColumn(out, F.when(F.col("_lbl").isNull(), F.lit(missing).cast("long")).otherwise(F.col("_code"))) \
        .drop("_lbl", "_code")


def fit_encoding(df: DataFrame, types: dict[str, str], method: str = "auto",
                 threshold: int = ONEHOT_THRESHOLD, target: str | None = None,
                 n_rows: int | None = None, max_onehot: int | None = None) -> EncodingPlan:
    """H1-H4: plan for every ``categorical``/``text`` column.

    The target is always label-encoded and renamed ``<target>_encoded``;
    others: ``label``, ``onehot``, or ``auto`` (one-hot when the distinct
    count, missing excluded, is at most ``threshold``).  One shuffle of
    ``(column, value)`` counts serves every column: distinct counts, one-hot
    categories (one output column each) and label values.  ``max_onehot``, if given,
    raises where a column would need more one-hot columns.
    """
    if method not in ("auto", "label", "onehot"):
        raise ValueError(f"unknown encoding method: {method}")
    cols = [c for c, t in types.items() if t in ("categorical", "text") and c in df.columns]
    if not cols:
        return EncodingPlan([], target)
    vc = value_counts(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        per = {r["column_name"]: (r["n_distinct"], r["n_present"]) for r in
               vc.groupBy("column_name").agg(F.count("*").alias("n_distinct"),
                                             F.sum("count").alias("n_present")).collect()}
        if n_rows is None:
            n_rows = df.count()
        encs = []
        existing = set(df.columns)
        new_target = target
        for c in cols:
            nd, present = per.get(c, (0, 0))
            has_null = (present or 0) < n_rows
            if c == target:
                encs.append(_label_from_counts(vc, c, has_null))
                new_target = f"{c}_encoded"
            elif method == "label" or (method == "auto" and nd > threshold):
                encs.append(_label_from_counts(vc, c, has_null))
            else:
                if max_onehot is not None and nd > max_onehot:
                    raise ValueError(f"{c}: {nd} values, {max_onehot} one-hot columns allowed")
                # as many values as columns are asked for
                cats = sorted(r["value"] for r in vc.where(F.col("column_name") == c).select("value").collect())
                encs.append(Encoding(c, "onehot", _onehot_names(c, cats, existing), categories=cats))
    finally:
        vc.unpersist()
    return EncodingPlan(encs, new_target)


def irrelevant_columns(df: DataFrame, plan: EncodingPlan | None, target: str | None,
                       drop_ids: bool = True, drop_constants: bool = True) -> list[str]:
    """Raw columns with an encoded version, plus (optionally) near-unique
    identifiers and constant columns.  The target stays unless it was encoded."""
    drop = []
    if plan is not None:
        for e in plan.encodings:
            if e.column in df.columns:
                drop.append(e.column)
    if drop_ids or drop_constants:
        rest = [c for c in df.columns if c not in drop and c != target
                and c not in ({o for e in plan.encodings for o in e.output} if plan else set())]
        if rest:
            stats = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, rest).collect()}
            n = df.count()
            for c in rest:
                k = stats.get(c, 0)
                if drop_constants and k <= 1:
                    drop.append(c)
                elif drop_ids and n > 1 and k == n and dict(df.dtypes)[c] in ("string", "bigint", "int"):
                    drop.append(c)
    return drop
