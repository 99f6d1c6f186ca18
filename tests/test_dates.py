"""Dates written as text: which format a column gets."""

import pytest
from pyspark.sql import functions as F

from loam.operators import features as FE
from loam.operators import semantic_types as ST


@pytest.mark.parametrize("values,fmt", [
    (["01/31/2024", "02/01/2024"], "M/d/yyyy"), (["31/01/2024", "02/01/2024"], "d/M/yyyy"),
    (["02/01/2024", "03/02/2024"], "M/d/yyyy"), (["5 Jan 2024", "16 Feb 2023"], "d MMM yyyy"),
    (["2024-01-05", "2024-02-06"], "iso"), (["31.12.2024", "1.2.2024"], "d.M.yyyy")])
def test_one_format_for_a_column(spark, values, fmt):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "t string")
    row = ST.detect_column_types(df).first()
    assert (row["semantic_type"], row["date_format"]) == ("datetime", fmt)
    out = FE.extract_datetime_features(df, {"t": "datetime"}).where(F.col("t").isNotNull())
    assert out.where("t_year in (2023, 2024)").count() == len(values)


def test_mixed_text_is_no_date(spark):
    df = spark.createDataFrame([("31/01/2024",), ("no date",)], "t string")
    assert ST.column_types(df)["t"] != "datetime"


def test_day_first_where_a_value_needs_it(spark):
    df = spark.createDataFrame([("31/01/2024",), ("02/03/2024",)], "t string")
    got = FE.extract_datetime_features(df, {"t": "datetime"}).select("t_month", "t_day").collect()
    assert sorted(map(tuple, got)) == [(1, 31), (3, 2)]


def test_types_alone_shuffle_no_numbers(spark, monkeypatch):
    seen = []
    real = ST.distinct_counts
    monkeypatch.setattr(ST, "distinct_counts", lambda df, cols: seen.append(list(cols)) or real(df, cols))
    df = spark.createDataFrame([(i, float(i), f"2024-01-{i + 1:02d}", f"w{i % 3}") for i in range(20)],
                               "a long, b double, d string, s string")
    assert ST.column_types(df) == {"a": "numeric", "b": "numeric", "d": "datetime", "s": "categorical"}
    assert seen == [["s"]]


@pytest.mark.parametrize("values,fmt", [
    (["20240131T235959", "20240201T000000"], "yyyyMMdd'T'HHmmss"), (["March 5, 2024", "May 16, 2023"], "MMMM d, yyyy"),
    (["Mar 5, 2024", "May 16, 2023"], "MMM d, yyyy"), (["2024-W01-1", "2020-W53-7"], "iso-week"),
    (["2024-05-01T10:00:00+02:00", "2024-05-01 10:00:00.123Z"], "iso"), (["1/31/24", "2/1/69"], "M/d/yy"),
    (["10/Oct/2000:13:55:36 -0700", "01/Jan/2001:00:00:00 +0000"], "d/MMM/yyyy:HH:mm:ss Z"),
    (["Fri, 5 Jan 2024", "Tuesday, 16 Feb 2023"], "d MMM yyyy"), (["12/31/2024 11:59 pm", "1/2/2024 1:05 AM"], "M/d/yyyy h:mm a")])
def test_open_grammar(spark, values, fmt):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    row = ST.detect_column_types(df).first()
    assert (row["semantic_type"], row["date_format"], row["datetime_like"]) == ("datetime", fmt, 2)


@pytest.mark.parametrize("text,fmt,day", [
    ("2024-W01-1", "iso-week", "2024-01-01"), ("2020-W53-7", "iso-week", "2021-01-03"), ("2021-W53-1", "iso-week", None),
    ("2021-W01-1", "iso-week", "2021-01-04"), ("2024-W10", "iso-week", "2024-03-04"), ("2/1/69", "M/d/yy", "1969-02-01"),
    ("2/1/68", "M/d/yy", "2068-02-01"), ("2024-366", "yyyy-DDD", "2024-12-31"), ("2023-366", "yyyy-DDD", None),
    ("31/02/2024", "d/M/yyyy", None)])
def test_days(spark, text, fmt, day):
    from loam.functions.dates import parse_date
    df = spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t"), fmt).cast("date").cast("string"))
    assert df.first()[0] == day


@pytest.mark.parametrize("values", [["1-2", "3-4"], ["x12", "y13"], ["2024-13-45", "2024-01-01"], ["10.0.0.1", "10.0.0.2"], ["", "2024-01-01"],
                                    ["May", "June"], ["2024-01-01" + " " * 50 + "x", "2024-01-01"]])
def test_no_dates(spark, values):
    assert ST.column_types(spark.createDataFrame([(v,) for v in values], "t string"))["t"] != "datetime"


def test_fitted_formats_are_kept(spark, tmp_path):
    """Day-first at fit stays day-first for a batch that could be read either way; transform starts no job."""
    from loam.plans.cleaning import CleaningPlan
    df = spark.createDataFrame([(f"{d}/0{m}/2024", float(d)) for d in range(10, 32) for m in (1, 3)], "Day string, v double")
    plan, _ = CleaningPlan().fit(df)
    assert plan.date_formats == {"day": "d/M/yyyy"}
    batch = spark.createDataFrame([("03/04/2024", 1.0)], "Day string, v double")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("transform-only", "")
    out = plan.transform(batch, keep_rows=True)
    assert not jobs.getJobIdsForGroup("transform-only")
    spark.sparkContext.setJobGroup("rest", "")
    assert out.select("day_month", "day_day").first() == (4, 3)
    back = CleaningPlan.load(spark, plan.save(spark, str(tmp_path / "plan")))
    assert (back.types, back.fills, back.trim_steps, back.names, back.date_formats) == (
        plan.types, plan.fills, plan.trim_steps, plan.names, plan.date_formats)
    assert sorted(map(str, back.transform(df).collect())) == sorted(map(str, plan.transform(df).collect()))
