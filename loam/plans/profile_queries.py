"""Checkable profiling queries (J*, D1, D7, A8-A10, A12, B7, B8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import profile as P
from loam.plans.registry import DIGITS, per_column_sql, r, register, rounded, table
from loam.sources import readers

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
CUSTOMER_STR = ["c_name", "c_mktsegment"]
PART_STR = ["p_name", "p_brand", "p_type"]


def _summary_sql(tab: str, cols: list[str]) -> str:
    t = (f"SELECT '{{c}}' AS column_name, {r('avg({c})')} AS mean, {r('quantile_cont({c}, 0.5)')} AS median, "
         f"{r('stddev_samp({c})')} AS std, {r('min({c})')} AS min, {r('max({c})')} AS max, "
         f"{r('skewness({c})')} AS skew, {r('kurtosis({c})')} AS kurtosis FROM {tab}")
    return per_column_sql(cols, t)


@register("numeric_summary_lineitem", _summary_sql("lineitem", LINEITEM_NUM))
def numeric_summary_lineitem(spark, sf_dir):
    """J2 over every numeric column of lineitem (one moments aggregate + exact medians)."""
    return rounded(P.numeric_summary(table(spark, sf_dir, "lineitem")))


@register("numeric_summary_part", _summary_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def numeric_summary_part(spark, sf_dir):
    return rounded(P.numeric_summary(table(spark, sf_dir, "part")))


_MISSING_TEMPLATE = ("SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing, "
                     + r("count_if({c} IS NULL) * 100.0 / count(*)") + " AS missing_pct FROM {t}")


def _missing_sql(tab, cols):
    return per_column_sql(cols, _MISSING_TEMPLATE.replace("{t}", tab))


_LABELS_DOCS_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@register("missing_values_documents_labels", _missing_sql(
    "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", _LABELS_DOCS_COLS))
def missing_values_documents_labels(spark, sf_dir):
    """D1 + D7 on documents left-joined to labels (labels cover only some documents)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    joined = d.join(lab, "doc_id", "left").select(*_LABELS_DOCS_COLS)
    return rounded(P.missing_counts(joined))


_META_COLS = [("o_orderkey", 0, "bigint"), ("o_custkey", 1, "bigint"), ("o_orderstatus", 2, "string"),
              ("o_totalprice", 3, "double"), ("o_orderdate", 4, "timestamp_ntz"),
              ("o_orderpriority", 5, "string")]


@register("dataset_metadata_orders", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, CAST(count_if({c} IS NULL) AS BIGINT) AS missing, "
    f"count(*) AS n_rows, 6 AS n_columns FROM orders" for c, i, t in _META_COLS))
def dataset_metadata_orders(spark, sf_dir):
    """Shape, dtypes and missing counts of orders."""
    return P.dataset_metadata(table(spark, sf_dir, "orders"))


def _topk_sql(tab, cols, k):
    inner = per_column_sql(cols, f"SELECT '{{c}}' AS column_name, CAST({{c}} AS VARCHAR) AS value, count(*) AS count "
                                 f"FROM {tab} WHERE {{c}} IS NOT NULL GROUP BY {{c}}")
    return (f"SELECT column_name, rank, value, count FROM (SELECT *, CAST(row_number() OVER "
            f"(PARTITION BY column_name ORDER BY count DESC, value ASC) AS INTEGER) AS rank FROM ({inner})) "
            f"WHERE rank <= {k}")


@register("top_values_part", _topk_sql("part", PART_STR, 10))
def top_values_part(spark, sf_dir):
    """Top 10 values of every string column of part."""
    return P.top_values(table(spark, sf_dir, "part"), k=10)


def _catsum_sql(tab, cols, k):
    inner = per_column_sql(cols, f"SELECT '{{c}}' AS column_name, CAST({{c}} AS VARCHAR) AS value, count(*) AS count "
                                 f"FROM {tab} WHERE {{c}} IS NOT NULL GROUP BY {{c}}")
    return (f"WITH vc AS ({inner}), u AS (SELECT column_name, count(*) AS unique_values FROM vc GROUP BY column_name) "
            f"SELECT t.column_name, u.unique_values, t.rank, t.value, t.count FROM (SELECT *, CAST(row_number() OVER "
            f"(PARTITION BY column_name ORDER BY count DESC, value ASC) AS INTEGER) AS rank FROM vc) t "
            f"JOIN u USING (column_name) "
            f"WHERE rank <= {k}")


@register("categorical_summary_customer", _catsum_sql("customer", CUSTOMER_STR, 5))
def categorical_summary_customer(spark, sf_dir):
    """Distinct count and top 5 values per string column of customer."""
    return P.categorical_summary(table(spark, sf_dir, "customer"), k=5)


@register("categorical_summary_lineitem", _catsum_sql("lineitem", ["l_returnflag", "l_linestatus"], 5))
def categorical_summary_lineitem(spark, sf_dir):
    return P.categorical_summary(table(spark, sf_dir, "lineitem"), k=5)


def _hist_sql(tab, cols, bins):
    inner = per_column_sql(cols, f"SELECT '{{c}}' AS column_name, CAST({{c}} AS DOUBLE) AS value FROM {tab} "
                                 f"WHERE {{c}} IS NOT NULL")
    b = (f"coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * {bins}), {bins - 1}), 0)")
    return (f"WITH v AS ({inner}), g AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1) "
            f"SELECT column_name, bin, {r(f'lo + (hi - lo) / {bins} * bin')} AS lower, "
            f"{r(f'lo + (hi - lo) / {bins} * (bin + 1)')} AS upper, count FROM ("
            f"SELECT column_name, CAST({b} AS INTEGER) AS bin, lo, hi, count(*) AS count FROM v JOIN g USING (column_name) "
            f"GROUP BY ALL)")


@register("histogram_lineitem", _hist_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 10))
def histogram_lineitem(spark, sf_dir):
    """10 equal-width bins per numeric measure of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(P.histogram(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], bins=10))


def _corr_sql(tab, cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols:
            parts.append(
                f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
                f"{r(f'CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END')} AS corr FROM {tab}")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix_lineitem", _corr_sql("lineitem", LINEITEM_NUM))
def correlation_matrix_lineitem(spark, sf_dir):
    """Pearson matrix over all numeric columns of lineitem, one aggregate job."""
    return rounded(P.correlation_matrix(table(spark, sf_dir, "lineitem")))


_TC_FEATURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("target_correlation_lineitem", (
    "SELECT feature, " + r("corr") + " AS corr, CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) "
    "AS INTEGER) AS rank "
    "FROM (" + per_column_sql(_TC_FEATURES, "SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS corr FROM lineitem")
    + ")"))
def target_correlation_lineitem(spark, sf_dir):
    """Feature-to-target correlation with target l_extendedprice, ranked by |corr|."""
    tc = P.target_correlation(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return tc.withColumn("corr", F.round("corr", DIGITS))


def _describe_sql(tab, cols):
    t = (f"SELECT '{{c}}' AS column_name, count({{c}}) AS count, {r('avg({c})')} AS mean, "
         f"{r('stddev_samp({c})')} AS std, {r('var_samp({c})', 2)} AS var, {r('min({c})')} AS min, "
         f"{r('quantile_cont({c}, 0.25)')} AS q25, {r('quantile_cont({c}, 0.5)')} AS median, "
         f"{r('quantile_cont({c}, 0.75)')} AS q75, {r('max({c})')} AS max, "
         f"(SELECT CAST({{c}} AS DOUBLE) FROM {tab} WHERE {{c}} IS NOT NULL GROUP BY {{c}} "
         f"ORDER BY count(*) DESC, {{c}} LIMIT 1) AS mode FROM {tab}")
    return per_column_sql(cols, t)


@register("describe_orders", _describe_sql("orders", ORDERS_NUM))
def describe_orders(spark, sf_dir):
    """Describe (count, quartiles, var, mode) of numeric columns of orders."""
    d = P.describe(table(spark, sf_dir, "orders"))
    return rounded(d.withColumn("var", F.round("var", 2)))


@register("string_describe_orders", per_column_sql(
    ["o_orderstatus", "o_orderpriority"],
    "SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
    "arg_min(v, [-n::DOUBLE]) AS top, max(n) AS freq FROM "
    "(SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"))
def string_describe_orders(spark, sf_dir):
    """J8 string part: count, unique, top, freq."""
    return P.string_describe(table(spark, sf_dir, "orders"))


@register("crosstab_orders_status_priority",
          "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders "
          "WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2")
def crosstab_orders_status_priority(spark, sf_dir):
    """Contingency table of order status x priority."""
    return P.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@register("box_stats_price_by_segment", (
    "SELECT c.c_mktsegment, count(o.o_totalprice) AS count, " + r("min(o.o_totalprice)") + " AS min, "
    + r("quantile_cont(o.o_totalprice, 0.25)") + " AS q1, " + r("quantile_cont(o.o_totalprice, 0.5)")
    + " AS median, " + r("quantile_cont(o.o_totalprice, 0.75)") + " AS q3, " + r("max(o.o_totalprice)")
    + " AS max FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
      "WHERE c.c_mktsegment IS NOT NULL GROUP BY 1"))
def box_stats_price_by_segment(spark, sf_dir):
    """Order value distribution per customer market segment (exact quartiles per group)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_totalprice")
    return rounded(P.box_stats(j, "c_mktsegment", "o_totalprice"))


@register("grouped_descriptive_events", per_column_sql(
    ["value", "user_id"],
    "SELECT event_type, '{c}' AS column_name, count({c}) AS count, CAST(count_if({c} IS NULL) AS BIGINT) AS missing, "
    + r("avg({c})") + " AS mean, " + r("quantile_cont({c}, 0.5)") + " AS median, " + r("stddev_samp({c})")
    + " AS std, " + r("min({c})") + " AS min, " + r("max({c})") + " AS max FROM events GROUP BY event_type"))
def grouped_descriptive_events(spark, sf_dir):
    """Descriptive statistics of events.value and user_id per event_type."""
    ev = table(spark, sf_dir, "events")
    return rounded(P.grouped_descriptive(ev, ["value", "user_id"], group_by=["event_type"]))


@register("aggregate_balance_by_segment",
          "SELECT c_mktsegment, " + r("avg(c_acctbal)") + " AS avg_balance, count(*) AS n_customers "
          "FROM customer GROUP BY 1")
def aggregate_balance_by_segment(spark, sf_dir):
    """J14: "average account balance of customers" per market segment."""
    c = table(spark, sf_dir, "customer")
    return rounded(P.aggregate(c, ["c_mktsegment"], {"avg_balance": F.avg("c_acctbal"),
                                                      "n_customers": F.count("*")}))


@register("filter_parts_over_price",
          "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 990")
def filter_parts_over_price(spark, sf_dir):
    """B7: "list all products with a price greater than 990"."""
    p = table(spark, sf_dir, "part")
    return P.filter_rows(p, F.col("p_retailprice") > 990).select("p_partkey", "p_name", "p_retailprice")


@register("class_balance_labels",
          "SELECT quality, count(*) AS count, " + r("count(*) / sum(count(*)) OVER ()") + " AS share "
          "FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_balance_labels(spark, sf_dir):
    """Class shares of labels.quality."""
    return rounded(P.class_balance(table(spark, sf_dir, "labels"), "quality"))


@register("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_orders(spark, sf_dir):
    """First five rows by key."""
    return readers.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 5)


@register("tail_orders", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def tail_orders(spark, sf_dir):
    """Last five rows by key."""
    return readers.tail(table(spark, sf_dir, "orders"), ["o_orderkey"], 5)


@register("sample_rows_customer",
          "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY "
          "CAST(('0x' || substr(md5('42|' || CAST(c_custkey AS VARCHAR)), 1, 13)) AS BIGINT), c_custkey LIMIT 10")
def sample_rows_customer(spark, sf_dir):
    """Ten customers chosen by a seeded hash of the key."""
    return readers.sample_rows(table(spark, sf_dir, "customer"), ["c_custkey"], n=10, seed=42)


_SCATTER_SQL = """WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
g AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
SELECT CAST(CASE WHEN x1 = x0 THEN 0 ELSE least(floor((x - x0) / (x1 - x0) * 20), 19) END AS INTEGER) AS x_bin,
  CAST(CASE WHEN y1 = y0 THEN 0 ELSE least(floor((y - y0) / (y1 - y0) * 20), 19) END AS INTEGER) AS y_bin,
  count(*) AS count FROM v, g GROUP BY 1, 2"""


@register("binned_scatter_lineitem", _SCATTER_SQL)
def binned_scatter_lineitem(spark, sf_dir):
    """2-D binned counts of quantity vs extended price (20 x 20 grid)."""
    return P.binned_scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", bins=20)


@register("numeric_projection_lineitem", "SELECT " + ", ".join(LINEITEM_NUM) + " FROM lineitem")
def numeric_projection_lineitem(spark, sf_dir):
    """Projection to the numeric columns chosen from the schema."""
    from loam.functions.schema import select_by_kind
    li = table(spark, sf_dir, "lineitem")
    return li.select(*select_by_kind(li, "numeric"))


@register("derived_columns_lineitem",
          "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, "
          "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def derived_columns_lineitem(spark, sf_dir):
    """Derived columns added side by side (no join).  Row-wise IEEE arithmetic is
    identical in both engines, so the values are compared unrounded."""
    from loam.operators.columns import add_columns
    li = table(spark, sf_dir, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = add_columns(li, {"revenue": rev, "charge": rev * (1 + F.col("l_tax"))})
    return out.select("l_orderkey", "l_linenumber", "revenue", "charge")


@register("correlation_selected_orders", _corr_sql("orders", ["o_totalprice", "o_custkey", "o_orderkey"]))
def correlation_selected_orders(spark, sf_dir):
    """Correlation restricted to chosen columns."""
    o = table(spark, sf_dir, "orders")
    return rounded(P.correlation_matrix(o, ["o_totalprice", "o_custkey", "o_orderkey"]))


_DIST_SQL = """WITH v AS (SELECT o_totalprice AS value FROM orders WHERE o_totalprice IS NOT NULL),
g AS (SELECT min(value) AS lo, max(value) AS hi FROM v),
b AS (SELECT CAST(coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * 8), 7), 0) AS INTEGER) AS bin, lo, hi,
  count(*) AS count FROM v, g GROUP BY ALL)
SELECT bin, CAST(round(lo + (hi - lo) / 8 * bin, 2) AS VARCHAR) || ' - ' || CAST(round(lo + (hi - lo) / 8 * (bin + 1), 2)
  AS VARCHAR) AS label, count FROM b"""


@register("distribution_order_value", _DIST_SQL)
def distribution_order_value(spark, sf_dir):
    """Labelled 8-bin distribution of the order value."""
    return P.distribution(table(spark, sf_dir, "orders"), "o_totalprice", bins=8)


_WIDE = [f"w{i}" for i in range(20)]


def _wide_exprs(sql: bool) -> list[str]:
    """Twenty columns from four of lineitem, each missing on other rows."""
    base = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return [f"CASE WHEN (l_orderkey + l_linenumber) % {i + 5} <> 0 THEN {base[i % 4]} * {i + 1} + {base[(i // 4) % 4]} END AS w{i}"
            for i in range(20)]


@register("correlation_wide_gaps_lineitem",
          "WITH t AS (SELECT " + ", ".join(_wide_exprs(True)) + " FROM lineitem) " + " UNION ALL ".join(
              f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})')} AS corr FROM t" for a in _WIDE for b in _WIDE))
def correlation_wide_gaps_lineitem(spark, sf_dir):
    """J6 on twenty columns with gaps on different rows: pairwise-complete, one scan for all sums."""
    return rounded(P.correlation_matrix(table(spark, sf_dir, "lineitem").selectExpr(*_wide_exprs(False)), _WIDE))


_LOG_VALUE = ("CAST(concat(CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END, event_id % 97 + 1, 'e', event_id % 601 - 300) "
              "AS DOUBLE)")


@register("quantiles_log_spaced_events",
          f"WITH t AS (SELECT event_type, {_LOG_VALUE} AS v FROM events) SELECT event_type, CAST(p AS DOUBLE) AS prob, "
          "quantile_cont(v, p) AS value FROM t, (SELECT unnest([0.0, 0.25, 0.75, 1.0]) AS p) "
          "GROUP BY event_type, p".replace("quantile_cont(v, p)", "CASE p WHEN 0.0 THEN min(v) WHEN 0.25 THEN quantile_disc(v, 0.25) "
                                           "WHEN 0.75 THEN quantile_disc(v, 0.75) ELSE max(v) END"))
def quantiles_log_spaced_events(spark, sf_dir):
    """Exact order statistics of values from 1e-300 to 1e302 of both signs by event type, with a small bound on what may be gathered."""
    from loam.operators.quantiles import long_values, solve_ranks
    t = table(spark, sf_dir, "events").selectExpr("event_type", f"{_LOG_VALUE} AS v")
    data = long_values(t, ["v"], ["event_type"])
    stats = data.groupBy("event_type", "column_name").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = stats.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in (0.0, 0.25, 0.75, 1.0)]))) \
        .withColumn("k", F.greatest(F.ceil(F.col("prob") * F.col("n")) - 1, F.lit(0)))
    found = solve_ranks(data, wanted.select("event_type", "column_name", "k", "n", "lo", "hi").distinct(),
                        ["event_type", "column_name"], cap=100, small=False)
    return wanted.join(found, ["event_type", "column_name", "k"]).select("event_type", "prob", "value")
