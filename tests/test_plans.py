"""Cleaning plan, streaming re-application, time series and encoding edge cases."""

import pytest
from pyspark.sql import functions as F

from loam.operators import encode as ENC
from loam.operators import evaluate as EV
from loam.operators import timeseries as TS
from loam.plans.cleaning import CleaningPlan


ROWS = [(i, f" Item {i % 4} ", None if i % 5 == 0 else float(i), f"2024-01-{(i % 28) + 1:02d}",
         "$1,000" if i % 2 else "$2,500.50") for i in range(60)]
SCHEMA = "Key long, `Item Name` string, Value double, `When` string, `Price Text` string"


def test_plan_fit_and_transform_agree(spark):
    df = spark.createDataFrame(ROWS + ROWS[:6], SCHEMA)
    plan, cleaned = CleaningPlan(target="Item Name").fit(df)
    assert plan.types["price_text"] == "numeric" and plan.types["when"] == "datetime"
    assert plan.types["item_name"] == "categorical"
    again = plan.transform(df)
    a = sorted(map(tuple, cleaned.select(*sorted(cleaned.columns)).collect()))
    b = sorted(map(tuple, again.select(*sorted(cleaned.columns)).collect()))
    assert a == b
    assert cleaned.count() == 60                      # six repeated rows removed
    assert cleaned.where(F.col("value").isNull()).count() == 0
    assert "item_name_encoded" in cleaned.columns     # target label-encoded
    assert {"when_year", "when_dayofweek"} <= set(cleaned.columns)
    assert cleaned.select(F.max("item_name_encoded")).first()[0] == 3


def test_plan_on_stream(spark, tmp_path):
    from loam.streaming.clean_stream import clean_stream, read_parquet_stream, run_available
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan, cleaned = CleaningPlan(target="Item Name").fit(df)
    land = str(tmp_path / "land")
    df.repartition(3).write.parquet(land)
    out = run_available(clean_stream(plan, read_parquet_stream(spark, land, df.schema)),
                        str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(out)
    assert got.count() == 60
    assert sorted(got.columns) == sorted(cleaned.columns)


def test_onehot_name_collisions(spark):
    df = spark.createDataFrame([("a b",), ("a_b",), (None,)], "c string")
    e = ENC.fit_encoding(df, {"c": "categorical"}, "onehot").encodings[0]
    assert len(set(e.output)) == 2
    out = ENC.apply_encoding(df, e)
    assert out.where(F.col(e.output[0]) | F.col(e.output[1])).count() == 2


def test_forecast_linear_series(spark):
    rows = [(f"2020-{m:02d}-15 00:00:00", 10.0 * m) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "t string, v double").select(F.to_timestamp("t").alias("t"), "v")
    s = TS.resample(df, "t", "v", "month")
    tr = TS.trend(s, "month").first()
    assert tr["direction"] == "increasing" and tr["slope"] == pytest.approx(10.0)
    f = TS.forecast(s, 2, "month").orderBy("period").collect()
    assert len(f) == 2 and f[0]["period"].month == 1 and f[0]["period"].year == 2021


def test_regression_metrics_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert EV.regression_metrics(df).first()["r2"] == 1.0
    df2 = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "label double, prediction double")
    assert EV.regression_metrics(df2).first()["r2"] == 0.0


def test_plan_on_text_only_and_numeric_only_tables(spark):
    text = spark.createDataFrame([(f"w{i % 3}", f"free text {i}") for i in range(40)], "Kind string, Note string")
    plan, out = CleaningPlan(target="Kind").fit(text)
    assert out.count() == 40 and "kind_encoded" in out.columns
    nums = spark.createDataFrame([(float(i), float(i % 7)) for i in range(40)], "a double, b double")
    plan2, out2 = CleaningPlan().fit(nums)
    assert out2.count() == 40 and plan2.encoding.encodings == []


def test_empty_profiles(spark):
    from loam.operators import outliers as OUT
    from loam.operators import profile as P
    only_text = spark.createDataFrame([("a",), ("b",)], "s string")
    assert P.numeric_summary(only_text).count() == 0
    assert OUT.detect_outliers(only_text).count() == 0
    assert P.categorical_summary(spark.createDataFrame([(1.0,)], "x double"), []).count() == 0
