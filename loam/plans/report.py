"""EDA report content (M9) as one tidy table ``(section, position, item, value)``.

Every section is a small Spark frame derived from the profiles; the report is
their union, written as a table rather than laid out as a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.formatting import with_fixed2
from loam.functions.schema import numeric_columns, string_columns
from loam.operators import profile as P


def eda_report(df: DataFrame, types: dict[str, str], cleaning_log: DataFrame | None = None) -> DataFrame:
    spark = df.sparkSession
    n_cols = len(df.columns)
    overview = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("overview").alias("section"), F.lit(0).alias("position"), F.lit("shape").alias("item"),
        F.concat(F.lit("Rows: "), F.col("n").cast("string"), F.lit(f", Columns: {n_cols}")).alias("value"))
    type_rows = spark.createDataFrame([("column types", i, c, t) for i, (c, t) in enumerate(types.items())],
                                      "section string, position int, item string, value string")
    miss = (P.missing_counts(df).where(F.col("missing") > 0)
            .select(F.lit("missing values").alias("section"), F.lit(0).alias("position"),
                    F.col("column_name").alias("item"),
                    F.concat(F.col("missing").cast("string"), F.lit(" missing values")).alias("value")))
    parts = [overview, type_rows, miss]
    nums = numeric_columns(df)
    if nums:
        stats = ["mean", "median", "std", "min", "max", "skew"]
        s = with_fixed2(P.numeric_summary(df, nums), {f"{k}_txt": k for k in stats})
        parts.append(s.select(
            F.lit("numeric summary").alias("section"), F.lit(0).alias("position"), F.col("column_name").alias("item"),
            F.concat(F.lit("Mean: "), F.col("mean_txt"), F.lit(", Median: "), F.col("median_txt"), F.lit(", Std: "),
                     F.col("std_txt"), F.lit(", Min: "), F.col("min_txt"), F.lit(", Max: "), F.col("max_txt"),
                     F.lit(", Skew: "), F.col("skew_txt"))
            .alias("value")))
    strs = string_columns(df)
    if strs:
        cs = P.categorical_summary(df, strs, k=5)
        parts.append(cs.select(
            F.lit("categorical summary").alias("section"), F.col("rank").cast("int").alias("position"),
            F.col("column_name").alias("item"),
            F.concat(F.col("unique_values").cast("string"), F.lit(" unique; "), F.col("value"), F.lit(": "),
                     F.col("count").cast("string")).alias("value")))
    if cleaning_log is not None:
        parts.append(cleaning_log.select(
            F.lit("cleaning steps").alias("section"), F.col("seq").alias("position"),
            F.coalesce(F.col("column_name"), F.col("step")).alias("item"),
            F.concat_ws(" ", "action", F.col("n_affected").cast("string"), "detail").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
