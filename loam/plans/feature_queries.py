"""Checkable encoding and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.text import safe_identifier
from loam.operators import columns as COL
from loam.operators import encode as ENC
from loam.operators import features as FE
from loam.operators import semantic_types as ST
from loam.plans.cleaning_queries import MESSY_ORDERS_SQL, messy_orders
from loam.plans.registry import r, register, rounded, table

# Fixed values for the SQL side only: the category labels of the test tables.
STATUS_VALUES = ["F", "O", "P"]
PRIORITY_VALUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENT_VALUES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _onehot_sql(col: str, values: list[str]) -> str:
    return ", ".join(f"coalesce({col} = '{v}', false) AS \"{safe_identifier(f'{col}_{v}')}\"" for v in values)


@register("label_encode_priority",
          "SELECT order_key, priority, dense_rank() OVER (ORDER BY coalesce(priority, 'nan')) - 1 AS priority_encoded "
          "FROM " + MESSY_ORDERS_SQL)
def label_encode_priority(spark, sf_dir):
    """H1: code-point rank of padded/missing priorities; missing is the label "nan"."""
    m = messy_orders(spark, sf_dir).select("order_key", "priority")
    return ENC.apply_encoding(m, ENC.fit_label(m, "priority"))


@register("label_encode_note",
          "SELECT order_key, note, dense_rank() OVER (ORDER BY coalesce(note, 'nan')) - 1 AS note_encoded "
          "FROM " + MESSY_ORDERS_SQL)
def label_encode_note(spark, sf_dir):
    """H1 on a near-unique text column: the distributed rank (range partitions + offsets)."""
    m = messy_orders(spark, sf_dir).select("order_key", "note")
    return ENC.apply_encoding(m, ENC.fit_label(m, "note"))


@register("onehot_orders",
          "SELECT o_orderkey, o_orderstatus, o_orderpriority, " + _onehot_sql("o_orderstatus", STATUS_VALUES) + ", "
          + _onehot_sql("o_orderpriority", PRIORITY_VALUES) + " FROM orders")
def onehot_orders(spark, sf_dir):
    """H2: one boolean column per distinct status and priority, originals kept."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    plan = ENC.fit_encoding(o, {"o_orderstatus": "categorical", "o_orderpriority": "categorical"}, "onehot")
    return plan.transform(o)


@register("auto_encode_customer",
          "SELECT *, " + _onehot_sql("c_mktsegment", SEGMENT_VALUES)
          + ", dense_rank() OVER (ORDER BY coalesce(c_name, 'nan')) - 1 AS c_name_encoded FROM customer")
def auto_encode_customer(spark, sf_dir):
    """C1 + H3: detected types drive encoding: few values one-hot, many values label codes."""
    c = table(spark, sf_dir, "customer")
    types = ST.column_types(c)
    return ENC.fit_encoding(c, types, "auto", threshold=10).transform(c)


@register("target_encode_orders",
          "SELECT *, " + _onehot_sql("o_orderstatus", STATUS_VALUES)
          + ", dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS o_orderpriority_encoded FROM orders")
def target_encode_orders(spark, sf_dir):
    """H4: the target (priority) is always label-encoded; other categoricals auto."""
    o = table(spark, sf_dir, "orders")
    types = ST.column_types(o)
    plan = ENC.fit_encoding(o, types, "auto", target="o_orderpriority")
    return plan.transform(o)


@register("datetime_features_orders",
          "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
          "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek, "
          "CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter FROM orders")
def datetime_features_orders(spark, sf_dir):
    """Year, month, day, day of week (Monday 0) and quarter of the order date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return FE.extract_datetime_features(o, {"o_orderdate": "datetime"})


@register("datetime_text_features_messy_orders",
          "SELECT order_key, CAST(order_date AS TIMESTAMP) AS order_date, CAST(year(CAST(order_date AS TIMESTAMP)) AS INTEGER) AS order_date_year, "
          "CAST(month(CAST(order_date AS TIMESTAMP)) AS INTEGER) AS order_date_month, CAST(day(CAST(order_date AS TIMESTAMP)) AS INTEGER) AS order_date_day, "
          "CAST(isodow(CAST(order_date AS TIMESTAMP)) - 1 AS INTEGER) AS order_date_dayofweek, "
          "CAST(quarter(CAST(order_date AS TIMESTAMP)) AS INTEGER) AS order_date_quarter FROM " + MESSY_ORDERS_SQL)
def datetime_text_features_messy_orders(spark, sf_dir):
    """C1 + I1: a text date column is detected, parsed and expanded."""
    m = messy_orders(spark, sf_dir).select("order_key", "order_date")
    types = ST.column_types(m)
    return FE.extract_datetime_features(m, types)


@register("modelling_date_parts_lineitem",
          "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year, CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month, "
          "CAST(day(l_shipdate) AS INTEGER) AS l_shipdate_day, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS l_shipdate_weekday FROM lineitem")
def modelling_date_parts_lineitem(spark, sf_dir):
    """Date parts for modelling; the timestamp itself is dropped."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return FE.modelling_date_parts(li)


_SPLIT_SQL = ("(SELECT *, row_number() OVER (ORDER BY h) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM "
              "(SELECT *, CAST(('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 13)) AS BIGINT) AS h "
              "FROM orders))")


@register("train_test_split_orders", f"SELECT o_orderkey, is_test FROM {_SPLIT_SQL}")
def train_test_split_orders(spark, sf_dir):
    """Exactly ceil(0.2 n) test rows chosen by a seeded hash; the cut is an exact order statistic."""
    o = table(spark, sf_dir, "orders")
    train, test = FE.train_test_split(o, ["o_orderkey"], 0.2, 42)
    return (train.select("o_orderkey", F.lit(False).alias("is_test"))
            .unionByName(test.select("o_orderkey", F.lit(True).alias("is_test"))))


@register("scale_test_orders", (
    f"WITH s AS {_SPLIT_SQL}, st AS (SELECT avg(o_totalprice) AS mp, stddev_pop(o_totalprice) AS sp, "
    "avg(o_custkey) AS mc, stddev_pop(o_custkey) AS sc FROM s WHERE NOT is_test) "
    "SELECT o_orderkey, " + r("(o_totalprice - mp) / sp") + " AS o_totalprice, " + r("(o_custkey - mc) / sc")
    + " AS o_custkey FROM s, st WHERE is_test"))
def scale_test_orders(spark, sf_dir):
    """I4: scaler fitted on the training rows (population std), applied to the test rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    train, test = FE.train_test_split(o, ["o_orderkey"], 0.2, 42)
    stats = FE.fit_scaler(train, ["o_totalprice", "o_custkey"])
    return rounded(FE.apply_scaler(test, stats))


@register("target_codes_from_train_orders", (
    f"WITH s AS {_SPLIT_SQL}, codes AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS label FROM "
    "(SELECT DISTINCT o_orderpriority AS v FROM s WHERE NOT is_test)) "
    "SELECT o_orderkey, label FROM s JOIN codes ON s.o_orderpriority = codes.v WHERE is_test"))
def target_codes_from_train_orders(spark, sf_dir):
    """Class labels coded on the training rows, applied to the test rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    train, test = FE.train_test_split(o, ["o_orderkey"], 0.2, 42)
    enc = ENC.fit_label(train, "o_orderpriority", null_label=None)
    enc.output = ["label"]
    return ENC.apply_encoding(test, enc, null_label=None).select("o_orderkey", "label")


@register("drop_irrelevant_customer",
          "SELECT c_nationkey, c_acctbal, " + _onehot_sql("c_mktsegment", SEGMENT_VALUES)
          + ", dense_rank() OVER (ORDER BY coalesce(c_name, 'nan')) - 1 AS c_name_encoded FROM customer")
def drop_irrelevant_customer(spark, sf_dir):
    """B3 + B2: raw columns with an encoded version and the unique key are dropped."""
    c = table(spark, sf_dir, "customer")
    plan = ENC.fit_encoding(c, ST.column_types(c), "auto")
    enc = plan.transform(c)
    return COL.drop_columns(enc, ENC.irrelevant_columns(enc, plan, target=None))


@register("align_columns_orders",
          "SELECT o_orderkey, o_totalprice, 0 AS o_discount, o_custkey FROM orders")
def align_columns_orders(spark, sf_dir):
    """Frame aligned to a training column list (missing added as 0, extra dropped, reordered)."""
    o = table(spark, sf_dir, "orders")
    return COL.align_columns(o, ["o_orderkey", "o_totalprice", "o_discount", "o_custkey"], fill=0)


@register("features_without_target_orders",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def features_without_target_orders(spark, sf_dir):
    """Feature projection without the target (name matched case-insensitively)."""
    x, _y = COL.split_features_target(table(spark, sf_dir, "orders"), "O_ORDERPRIORITY")
    return x
