"""Physical-plan properties the design relies on."""

import pytest

import __spark_entry__ as entry
from loam.functions.schema import numeric_columns
from loam.operators import profile as P
from loam.sources.readers import read_table

SF = "/root/testdata/sf0.001"
NO_PAIRS = ["numeric_summary_lineitem", "histogram_lineitem", "correlation_matrix_lineitem",
            "column_types_messy_orders", "impute_messy_orders", "detect_outliers_zscore_events",
            "list_outliers_events", "label_encode_note", "train_test_split_orders", "roc_auc_quality",
            "roc_curve_quality", "box_stats_price_by_segment", "grouped_descriptive_events", "forecast_orders",
            "binned_scatter_lineitem", "clean_dataset_orders_customer"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_reaches_parquet(spark):
    df = entry.queries()["filter_parts_over_price"](spark, SF)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(p_retailprice), GreaterThan(p_retailprice,990.0)]" in plan


def test_moments_are_code_generated(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        li = read_table(spark, SF, "lineitem")
        plan = _plan(P.moments(li, numeric_columns(li)))
        assert "*(1) HashAggregate" in plan or "*(2) HashAggregate" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_values_limit_before_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = read_table(spark, SF, "documents")
        plan = _plan(P.top_values(d, ["text", "lang"], k=5))
        assert "WindowGroupLimit" in plan and "Partial" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scan_reads_only_needed_columns(spark):
    li = read_table(spark, SF, "lineitem")
    plan = _plan(P.histogram(li, ["l_quantity"]))
    assert "ReadSchema: struct<l_quantity:double>" in plan
