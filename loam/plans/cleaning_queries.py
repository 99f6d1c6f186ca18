"""Checkable typing and cleaning queries.

Faulty inputs are built from the test tables with the same expressions on
both sides (NULLs by key modulus, currency strings, padded text, repeated
rows); the operators under test then do all of the work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.numeric_text import NUMERIC_TEXT_PATTERN, coerce_numeric, looks_numeric
from loam.operators import columns as COL
from loam.operators import duplicates as DUP
from loam.operators import missing as MIS
from loam.operators import outliers as OUT
from loam.operators import semantic_types as ST
from loam.operators import text_columns as TXT
from loam.plans.registry import per_column_sql, r, register, rounded, table

# ----------------------------------------------------------------- stand-in inputs


def messy_orders(spark, sf_dir):
    """orders with faults: NULLs, currency text, date text, padded categories, a name with blanks."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pri = F.col("o_orderpriority")
    return o.select(
        k.alias("order_key"),
        F.when(k % 7 == 0, None).otherwise(F.col("o_custkey")).alias("cust_key"),
        F.col("o_orderstatus").alias("Order Status"),
        F.when(k % 11 == 0, None).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .alias("Total-Price"),
        F.when(k % 19 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(k % 13 == 0, None).when(k % 5 == 0, F.concat(F.lit("  "), pri, F.lit("  "))).otherwise(pri)
        .alias("priority"),
        F.when(k % 17 == 0, None).otherwise(F.concat(F.lit("order no "), k.cast("string"))).alias("note"),
    )


MESSY_ORDERS_SQL = (
    "(SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust_key, "
    "o_orderstatus AS \"Order Status\", CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '$' || format('{:,.2f}', o_totalprice) END "
    "AS \"Total-Price\", CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date, "
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderpriority || '  ' "
    "ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'order no ' || "
    "CAST(o_orderkey AS VARCHAR) END AS note FROM orders)")

# the same fixed pattern as the library, quoted for SQL
_NUM_RE_SQL = NUMERIC_TEXT_PATTERN.replace("'", "''")


def looks_num_sql(v: str) -> str:
    return f"(regexp_full_match({v}, '{_NUM_RE_SQL}') AND regexp_matches({v}, '[0-9]'))"


# ----------------------------------------------------------------- B1, C1


@register("standardize_names_messy_orders",
          "SELECT order_key, cust_key, \"Order Status\" AS order_status, \"Total-Price\" AS total_price, order_date, "
          "priority, note FROM " + MESSY_ORDERS_SQL)
def standardize_names_messy_orders(spark, sf_dir):
    """B1: lower-case names, blanks and hyphens to underscores."""
    out, _mapping, _t = COL.standardize_column_names(messy_orders(spark, sf_dir), "Total-Price")
    return out


_TYPES_SQL = f"""
WITH m AS {MESSY_ORDERS_SQL},
s AS (SELECT * FROM m),
ev AS (
  SELECT 'order_key' AS column_name, 'number' AS kind, count(*) AS n_rows, count(order_key) AS non_null, 0 AS num_like, 0 AS dt_like, count(DISTINCT order_key) AS n_distinct FROM s
  UNION ALL SELECT 'cust_key', 'number', count(*), count(cust_key), 0, 0, count(DISTINCT cust_key) FROM s
  UNION ALL SELECT 'Order Status', 'string', count(*), count("Order Status"), count_if({looks_num_sql('"Order Status"')}), count_if(TRY_CAST("Order Status" AS TIMESTAMP) IS NOT NULL), count(DISTINCT "Order Status") FROM s
  UNION ALL SELECT 'Total-Price', 'string', count(*), count("Total-Price"), count_if({looks_num_sql('"Total-Price"')}), count_if(TRY_CAST("Total-Price" AS TIMESTAMP) IS NOT NULL), count(DISTINCT "Total-Price") FROM s
  UNION ALL SELECT 'order_date', 'string', count(*), count(order_date), count_if({looks_num_sql('order_date')}), count_if(TRY_CAST(order_date AS TIMESTAMP) IS NOT NULL), count(DISTINCT order_date) FROM s
  UNION ALL SELECT 'priority', 'string', count(*), count(priority), count_if({looks_num_sql('priority')}), count_if(TRY_CAST(priority AS TIMESTAMP) IS NOT NULL), count(DISTINCT priority) FROM s
  UNION ALL SELECT 'note', 'string', count(*), count(note), count_if({looks_num_sql('note')}), count_if(TRY_CAST(note AS TIMESTAMP) IS NOT NULL), count(DISTINCT note) FROM s
)
SELECT column_name, non_null, n_distinct,
  CASE WHEN kind = 'number' THEN 'numeric'
       WHEN kind = 'string' AND non_null > 0 AND non_null >= least(10, n_rows) AND num_like = non_null THEN 'numeric'
       WHEN kind = 'string' AND non_null > 0 AND dt_like = non_null THEN 'datetime'
       WHEN n_distinct < least(50, n_rows * 0.5) THEN 'categorical'
       ELSE 'text' END AS semantic_type
FROM ev"""


@register("column_types_messy_orders", _TYPES_SQL)
def column_types_messy_orders(spark, sf_dir):
    """Semantic type of every column of the faulty orders table."""
    t = ST.detect_column_types(messy_orders(spark, sf_dir))
    return t.select("column_name", "non_null", "n_distinct", "semantic_type")


# ----------------------------------------------------------------- C2, C4


def balance_text(spark, sf_dir):
    """customer balances written six ways: currency, percent, plain, exponent, quoted, junk."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    fmt = F.format_number("c_acctbal", 2)
    raw = (F.when(k % 6 == 0, F.concat(F.lit("$"), fmt))
           .when(k % 6 == 1, F.concat(fmt, F.lit("%")))
           .when(k % 6 == 2, F.col("c_acctbal").cast("string"))
           .when(k % 6 == 3, F.concat(F.lit("1e"), (k % 9).cast("string")))
           .when(k % 6 == 4, F.concat(F.lit("'"), fmt, F.lit("'")))
           .otherwise(F.lit("n/a")))
    return c.select("c_custkey", raw.alias("raw"))


BALANCE_TEXT_SQL = (
    "(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '$' || format('{:,.2f}', c_acctbal) "
    "WHEN 1 THEN format('{:,.2f}', c_acctbal) || '%' WHEN 2 THEN CAST(c_acctbal AS VARCHAR) "
    "WHEN 3 THEN '1e' || CAST(c_custkey % 9 AS VARCHAR) WHEN 4 THEN '''' || format('{:,.2f}', c_acctbal) || '''' "
    "ELSE 'n/a' END AS raw FROM customer)")


@register("numeric_text_coercion_customer",
          f"SELECT c_custkey, raw, coalesce({looks_num_sql('raw')}, false) AS looks_numeric, "
          f"TRY_CAST(regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value FROM {BALANCE_TEXT_SQL}")
def numeric_text_coercion_customer(spark, sf_dir):
    """C2 predicate and C4 coercion on balances written as text."""
    b = balance_text(spark, sf_dir)
    return b.select("c_custkey", "raw", F.coalesce(looks_numeric(F.col("raw")), F.lit(False)).alias("looks_numeric"),
                    coerce_numeric(F.col("raw")).alias("value"))


@register("eager_coercion_messy_orders", per_column_sql(
    ["order_key", "cust_key", "Order Status", "Total-Price", "order_date", "priority", "note"],
    "SELECT '{c}' AS column_name, CASE WHEN bool_or(TRY_CAST(CAST(\"{c}\" AS VARCHAR) AS DOUBLE) IS NOT NULL) THEN 'numeric' "
    "WHEN bool_or(TRY_CAST(CAST(\"{c}\" AS VARCHAR) AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE 'string' END "
    "AS coerced_type FROM " + MESSY_ORDERS_SQL))
def eager_coercion_messy_orders(spark, sf_dir):
    """Legacy eager rule (numeric if any value parses, else datetime if any parses)."""
    return ST.eager_coercion_types(messy_orders(spark, sf_dir))


@register("problem_type_targets", (
    "SELECT 'o_totalprice' AS target, count(*) AS n, count(DISTINCT o_totalprice) AS n_distinct, "
    "CASE WHEN count(DISTINCT o_totalprice) >= least(50, count(*) * 0.5) THEN 'regression' ELSE 'classification' END "
    "AS problem_type FROM orders UNION ALL "
    "SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority), 'classification' FROM orders UNION ALL "
    "SELECT 'quality', count(*), count(DISTINCT quality), CASE WHEN count(DISTINCT quality) >= least(50, count(*) * 0.5) "
    "THEN 'regression' ELSE 'classification' END FROM labels"))
def problem_type_targets(spark, sf_dir):
    """Regression vs classification for three candidate targets."""
    o = table(spark, sf_dir, "orders")
    lab = table(spark, sf_dir, "labels")
    return (ST.detect_problem_type(o, "o_totalprice")
            .unionByName(ST.detect_problem_type(o, "o_orderpriority"))
            .unionByName(ST.detect_problem_type(lab, "quality")))


# ----------------------------------------------------------------- D2-D6


def typed_messy_orders(spark, sf_dir):
    m = messy_orders(spark, sf_dir)
    types, evidence = ST.column_types_with_evidence(m)
    return ST.format_numeric_columns(m, types), types, evidence


@register("drop_missing_messy_orders", "SELECT * FROM " + MESSY_ORDERS_SQL + " WHERE cust_key IS NOT NULL AND "
          "\"Total-Price\" IS NOT NULL AND order_date IS NOT NULL AND priority IS NOT NULL AND note IS NOT NULL")
def drop_missing_messy_orders(spark, sf_dir):
    """Rows with any missing value removed."""
    return MIS.drop_missing_rows(messy_orders(spark, sf_dir))


_IMPUTE_SQL = f"""
WITH m AS (SELECT order_key, cust_key, "Order Status", TRY_CAST(regexp_replace("Total-Price", '[^0-9.\\-]', '', 'g') AS DOUBLE)
           AS "Total-Price", order_date, priority, note FROM {MESSY_ORDERS_SQL}),
pm AS (SELECT priority AS v FROM m WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT order_key, coalesce(CAST(cust_key AS DOUBLE), (SELECT quantile_cont(cust_key, 0.5) FROM m)) AS cust_key,
  "Order Status", {r('coalesce("Total-Price", (SELECT quantile_cont("Total-Price", 0.5) FROM m))')} AS "Total-Price",
  order_date, coalesce(priority, (SELECT v FROM pm)) AS priority, coalesce(note, 'MISSING') AS note FROM m"""


@register("impute_messy_orders", _IMPUTE_SQL)
def impute_messy_orders(spark, sf_dir):
    """C1 + C4 + D3-D5: typed fills: exact median, mode (smallest on tie), "MISSING"; dates left."""
    df, types, evidence = typed_messy_orders(spark, sf_dir)
    out, _plan = MIS.handle_missing(df, types, "auto", evidence)
    return rounded(out)


_DTYPE_IMPUTE_SQL = f"""
WITH m AS {MESSY_ORDERS_SQL}
SELECT order_key, coalesce(CAST(cust_key AS DOUBLE), (SELECT quantile_cont(cust_key, 0.5) FROM m)) AS cust_key,
  "Order Status",
  coalesce("Total-Price", (SELECT v FROM (SELECT "Total-Price" AS v FROM m WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1))) AS "Total-Price",
  coalesce(order_date, (SELECT v FROM (SELECT order_date AS v FROM m WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1))) AS order_date,
  coalesce(priority, (SELECT v FROM (SELECT priority AS v FROM m WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1))) AS priority,
  coalesce(note, (SELECT v FROM (SELECT note AS v FROM m WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1))) AS note
FROM m"""


@register("impute_by_dtype_messy_orders", _DTYPE_IMPUTE_SQL)
def impute_by_dtype_messy_orders(spark, sf_dir):
    """Legacy rule: numeric physical columns get the median, all others the mode."""
    out, _plan = MIS.impute_by_dtype(messy_orders(spark, sf_dir))
    return out


# ----------------------------------------------------------------- E1-E6

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]


@register("detect_outliers_zscore_lineitem", per_column_sql(
    LINEITEM_NUM,
    "SELECT '{c}' AS column_name, CAST(count_if(abs(({c} - m) / nullif(s, 0)) > 3.0) AS BIGINT) AS n_outliers "
    "FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"))
def detect_outliers_zscore_lineitem(spark, sf_dir):
    """|z| > 3 counts per numeric column."""
    return OUT.detect_outliers(table(spark, sf_dir, "lineitem"), "zscore", 3.0)


@register("detect_outliers_iqr_lineitem", per_column_sql(
    LINEITEM_NUM,
    "SELECT '{c}' AS column_name, CAST(count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) "
    "AS n_outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"))
def detect_outliers_iqr_lineitem(spark, sf_dir):
    """Values outside the 1.5 IQR fences per numeric column."""
    return OUT.detect_outliers(table(spark, sf_dir, "lineitem"), "iqr")


def _sequential_sql(cols, test, tab="lineitem", keys="l_orderkey, l_linenumber"):
    ctes = [f"t0 AS (SELECT * FROM {tab})"]
    for i, c in enumerate(cols):
        ctes.append(f"t{i + 1} AS (SELECT t{i}.* FROM t{i}, (SELECT {test['stats'].format(c=c)} FROM t{i}) st "
                    f"WHERE {test['keep'].format(c=c)})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {keys} FROM t{len(cols)}"


_Z = {"stats": "avg({c}) AS m, stddev_samp({c}) AS s",
      "keep": "coalesce(abs(({c} - st.m) / nullif(st.s, 0)) <= 3.0, true)"}
_IQR = {"stats": "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3",
        "keep": "coalesce({c} >= st.q1 - 1.5 * (st.q3 - st.q1) AND {c} <= st.q3 + 1.5 * (st.q3 - st.q1), true)"}
_TRIM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("remove_outliers_zscore_lineitem", _sequential_sql(_TRIM_COLS, _Z))
def remove_outliers_zscore_lineitem(spark, sf_dir):
    """Sequential z-score trimming over the four measures (stats recomputed on survivors)."""
    li = table(spark, sf_dir, "lineitem")
    return OUT.remove_outliers(li, "zscore", 3.0, columns=_TRIM_COLS).select("l_orderkey", "l_linenumber")


@register("remove_outliers_iqr_lineitem", _sequential_sql(_TRIM_COLS, _IQR))
def remove_outliers_iqr_lineitem(spark, sf_dir):
    """Sequential IQR trimming, fences inclusive."""
    li = table(spark, sf_dir, "lineitem")
    return OUT.remove_outliers(li, "iqr", columns=_TRIM_COLS).select("l_orderkey", "l_linenumber")


@register("list_outliers_lineitem", per_column_sql(
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "SELECT l_orderkey, l_linenumber, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value, "
    + r("abs(({c} - m) / s)") + " AS z, " + r("m") + " AS mean, " + r("s") + " AS std, CAST(3.0 AS DOUBLE) AS threshold "
    "FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem) WHERE abs(({c} - m) / s) > 3.0"))
def list_outliers_lineitem(spark, sf_dir):
    """E5: each outlying value with its z-score."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(OUT.list_outliers(li, ["l_orderkey", "l_linenumber"], 3.0,
                                     ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_EV_COLS = ["user_id", "value"]


@register("detect_outliers_zscore_events", per_column_sql(
    _EV_COLS,
    "SELECT '{c}' AS column_name, CAST(count_if(abs(({c} - m) / nullif(s, 0)) > 3.0) AS BIGINT) AS n_outliers "
    "FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events)"))
def detect_outliers_zscore_events(spark, sf_dir):
    """E1 on events (heavy-tailed values)."""
    return OUT.detect_outliers(table(spark, sf_dir, "events"), "zscore", 3.0, columns=_EV_COLS)


@register("remove_outliers_zscore_events", _sequential_sql(_EV_COLS, _Z, "events", "event_id"))
def remove_outliers_zscore_events(spark, sf_dir):
    """E3 on events: user_id then value, stats recomputed on the survivors."""
    ev = table(spark, sf_dir, "events")
    return OUT.remove_outliers(ev, "zscore", 3.0, columns=_EV_COLS).select("event_id")


@register("remove_outliers_iqr_events", _sequential_sql(_EV_COLS, _IQR, "events", "event_id"))
def remove_outliers_iqr_events(spark, sf_dir):
    """E4 on events: inclusive IQR fences, sequential."""
    ev = table(spark, sf_dir, "events")
    return OUT.remove_outliers(ev, "iqr", columns=_EV_COLS).select("event_id")


@register("remove_outliers_simultaneous_events", (
    "SELECT event_id FROM events, (SELECT avg(user_id) AS mu, stddev_samp(user_id) AS su, avg(value) AS mv, "
    "stddev_samp(value) AS sv FROM events) st WHERE coalesce(abs((user_id - mu) / nullif(su, 0)) <= 3.0, true) "
    "AND coalesce(abs((value - mv) / nullif(sv, 0)) <= 3.0, true)"))
def remove_outliers_simultaneous_events(spark, sf_dir):
    """E3 option: every column judged against statistics of the input, one filter."""
    ev = table(spark, sf_dir, "events")
    return OUT.remove_outliers(ev, "zscore", 3.0, columns=_EV_COLS, mode="simultaneous").select("event_id")


@register("list_outliers_events", (
    "SELECT event_id, 'value' AS column_name, value, " + r("abs((value - m) / s)") + " AS z, " + r("m")
    + " AS mean, " + r("s") + " AS std, CAST(3.0 AS DOUBLE) AS threshold FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s "
    "FROM events) WHERE abs((value - m) / s) > 3.0"))
def list_outliers_events(spark, sf_dir):
    """E5: every event value more than three standard deviations from the mean."""
    ev = table(spark, sf_dir, "events")
    return rounded(OUT.list_outliers(ev, ["event_id"], 3.0, ["value"]))


def bad_prices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", F.when(k % 50 == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice"))
                    .alias("retail_price"), F.col("p_size").alias("size"))


@register("fix_ranges_part", (
    "WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN -p_retailprice ELSE p_retailprice END AS retail_price, "
    "p_size AS size FROM part) SELECT p_partkey, CASE WHEN retail_price < 0 THEN (SELECT quantile_cont(retail_price, 0.5) "
    "FROM b) ELSE retail_price END AS retail_price, size FROM b"))
def fix_ranges_part(spark, sf_dir):
    """Negative prices (rule "price" >= 0) replaced by the column median."""
    out, _log = OUT.fix_ranges(bad_prices(spark, sf_dir))
    return out


# ----------------------------------------------------------------- F1-F5

_UNICODE_WS = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@register("clean_text_conversations",
          f"SELECT conv_id, turn, role, trim(regexp_replace(text, '{_UNICODE_WS}', ' ', 'g')) AS text FROM conversations")
def clean_text_conversations(spark, sf_dir):
    """whitespace runs collapsed and trimmed in every string column of conversations."""
    return TXT.clean_text_columns(table(spark, sf_dir, "conversations"))


@register("standardize_text_documents",
          "SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^" + _UNICODE_WS + "|" + _UNICODE_WS
          + "$', '', 'g')), '[^\\pL\\pN\\pM_\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
            "\\x{202F}\\x{205F}\\x{3000}]', '', 'g') AS text FROM documents")
def standardize_text_documents(spark, sf_dir):
    """lower, strip, punctuation removed from document text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return TXT.standardize_text_columns(d)


@register("latin1_text_documents",
          "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x{FF}]', '', 'g') AS text FROM documents")
def latin1_text_documents(spark, sf_dir):
    """characters outside Latin-1 dropped."""
    return TXT.latin1_text_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("ascii_text_documents",
          "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g') AS text FROM documents")
def ascii_text_documents(spark, sf_dir):
    """runs of non-ASCII characters replaced by one space."""
    return TXT.ascii_text_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("sanitize_names_part",
          "SELECT p_partkey, regexp_replace(p_brand || ' (' || p_type || ')', '[\\\\/*?:\"<>|()\\s]', '_', 'g') AS safe_name "
          "FROM part")
def sanitize_names_part(spark, sf_dir):
    """safe identifiers from brand and type labels."""
    p = table(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")).alias("safe_name"))
    return TXT.sanitize_values(raw, ["safe_name"])


# ----------------------------------------------------------------- G1


def orders_with_copies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.unionAll(o.where(F.col("o_orderkey") % 10 == 0))


@register("remove_duplicates_orders",
          "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)")
def remove_duplicates_orders(spark, sf_dir):
    """G1: exact duplicate rows removed (orders with every tenth row repeated)."""
    return DUP.remove_duplicates(orders_with_copies(spark, sf_dir))


# ----------------------------------------------------------------- small tables (typing branches)


def _types_sql(tab: str, cols: list[tuple[str, str]]) -> str:
    """The C1 rules in SQL for a plain table: ``cols`` is ``(name, 'number'|'string'|'datetime')``."""
    parts = []
    for c, kind in cols:
        if kind == "string":
            num = f"count_if({looks_num_sql(c)})"
            dt = f"count_if(TRY_CAST({c} AS TIMESTAMP) IS NOT NULL)"
        else:
            num, dt = "0", "0"
        parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(*) AS n_rows, count({c}) AS non_null, "
                     f"{num} AS num_like, {dt} AS dt_like, count(DISTINCT {c}) AS n_distinct FROM {tab}")
    ev = " UNION ALL ".join(parts)
    return f"""SELECT column_name, non_null, n_distinct,
  CASE WHEN kind = 'number' THEN 'numeric'
       WHEN kind = 'string' AND non_null > 0 AND non_null >= least(10, n_rows) AND num_like = non_null THEN 'numeric'
       WHEN kind = 'string' AND non_null > 0 AND dt_like = non_null THEN 'datetime'
       WHEN kind = 'datetime' THEN 'datetime'
       WHEN n_distinct < least(50, n_rows * 0.5) THEN 'categorical'
       ELSE 'text' END AS semantic_type
FROM ({ev})"""


@register("column_types_region", _types_sql("region", [("r_regionkey", "number"), ("r_name", "string")]))
def column_types_region(spark, sf_dir):
    """C1 on a five-row table: the 0.5 n bound makes every label column text."""
    t = ST.detect_column_types(table(spark, sf_dir, "region"))
    return t.select("column_name", "non_null", "n_distinct", "semantic_type")


@register("column_types_nation", _types_sql("nation", [("n_nationkey", "number"), ("n_name", "string"),
                                                       ("n_regionkey", "number")]))
def column_types_nation(spark, sf_dir):
    """C1 on the 25-row nation table."""
    t = ST.detect_column_types(table(spark, sf_dir, "nation"))
    return t.select("column_name", "non_null", "n_distinct", "semantic_type")


@register("column_types_events", _types_sql("events", [("event_id", "number"), ("ts", "datetime"),
                                                       ("user_id", "number"), ("event_type", "string"),
                                                       ("value", "number"), ("props", "string")]))
def column_types_events(spark, sf_dir):
    """C1 on the event table: a timestamp column, a JSON text column, a categorical."""
    t = ST.detect_column_types(table(spark, sf_dir, "events"))
    return t.select("column_name", "non_null", "n_distinct", "semantic_type")


@register("detect_outliers_iqr_supplier", per_column_sql(
    ["s_suppkey", "s_nationkey", "s_acctbal"],
    "SELECT '{c}' AS column_name, CAST(count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) "
    "AS n_outliers FROM supplier, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM supplier)"))
def detect_outliers_iqr_supplier(spark, sf_dir):
    """E2 on the supplier table."""
    return OUT.detect_outliers(table(spark, sf_dir, "supplier"), "iqr")


_DATE_TEXTS = {"us": ("M/d/yyyy", "%-m/%-d/%Y"), "eu": ("d/M/yyyy", "%-d/%-m/%Y"), "named": ("d MMM yyyy", "%-d %b %Y"),
               "dotted": ("dd.MM.yyyy", "%d.%m.%Y")}


def _date_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(c) for c, (f, _) in _DATE_TEXTS.items()])


@register("date_text_types_orders", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'datetime' AS semantic_type" for c in _DATE_TEXTS))
def date_text_types_orders(spark, sf_dir):
    """Month-first, day-first, named-month and dotted dates are told as dates."""
    from loam.operators import semantic_types as ST
    return ST.detect_column_types(_date_texts(spark, sf_dir), list(_DATE_TEXTS)).select("column_name", "semantic_type")


# One text for each of these formats: the name of a column, how Spark writes it, and how DuckDB reads the date back.
_GRAMMAR = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy",
            "d/M/yyyy", "d.M.yyyy", "M-d-yyyy", "d-M-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d-MMM-yyyy", "d MMMM yyyy",
            "MMMM d, yyyy", "MMMM d yyyy", "d. MMMM yyyy", "yyyyMMdd'T'HHmmss", "yyyyMMdd HH:mm:ss", "yyyyMMdd'T'HHmmssX", "yyyy-DDD",
            "M/d/yy", "d/M/yy", "d.M.yy", "d-MMM-yy", "M/d/yyyy H:mm", "d/M/yyyy H:mm:ss", "M/d/yyyy h:mm a", "MMM d, yyyy h:mm:ss a",
            "d/MMM/yyyy:HH:mm:ss Z", "EEEE, d MMMM yyyy", "EEE, d MMM yyyy H:mm:ss Z"]


def _grammar_texts(spark, sf_dir):
    """Every order's day, with a time of the day made from its key, in each format; the ISO week by its parts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # few bytes of a file become many texts: spread by cores, not by the splits of the file
    o = o.repartition(4 * spark.sparkContext.defaultParallelism).select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr(
        "make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400)")).alias("t"))
    week = F.format_string("%04d-W%02d-%d", F.extract(F.lit("YEAROFWEEK"), "t"), F.weekofyear("t"), F.weekday("t") + 1)
    return o.select("o_orderkey", *[F.date_format("t", f).alias(f"f{i}") for i, f in enumerate(_GRAMMAR)], week.alias("week"))


_GRAMMAR_COLUMNS = [*(f"f{i}" for i in range(len(_GRAMMAR))), "week"]


@register("date_grammar_types_orders", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'datetime' AS semantic_type, count(*) AS datetime_like FROM orders" for c in _GRAMMAR_COLUMNS))
def date_grammar_types_orders(spark, sf_dir):
    """Zones, fractions, ISO weeks and days of the year, compact dates, long names, two-digit years, weekdays."""
    from loam.operators import semantic_types as ST
    return ST.detect_column_types(_grammar_texts(spark, sf_dir), _GRAMMAR_COLUMNS, count_all=False) \
        .select("column_name", "semantic_type", "datetime_like")


@register("date_grammar_days_orders", "SELECT o_orderkey, " + ", ".join(
    f"o_orderdate::DATE AS {c}" for c in _GRAMMAR_COLUMNS) + " FROM orders")
def date_grammar_days_orders(spark, sf_dir):
    """I1 on the same texts: the day that was written, in every format."""
    from loam.functions.dates import parse_date
    from loam.operators import semantic_types as ST
    df = _grammar_texts(spark, sf_dir)
    formats = ST.date_formats(df, _GRAMMAR_COLUMNS)
    return df.select("o_orderkey", *[parse_date(F.col(c), formats[c]).cast("date").alias(c) for c in _GRAMMAR_COLUMNS])


@register("cleaning_plan_dates_reapplied",
          "SELECT o_orderkey, " + ", ".join(f"{p}(o_orderdate)::INTEGER AS placed_{p}" for p in ("year", "month", "day"))
          + " FROM orders WHERE day(o_orderdate) <= 12")
def cleaning_plan_dates_reapplied(spark, sf_dir):
    """M11 + I1: a plan fitted on day-first dates, saved and loaded, reads a batch of days up to the
    12th, which could be months by themselves, day first."""
    from loam.plans.cleaning import CleaningPlan
    from loam.sources import sinks
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("placed"))
    plan, _ = CleaningPlan().fit(o)
    path = plan.save(spark, sinks.new_output_path(spark, "plan"))
    batch = o.where(F.split("placed", "/")[0].cast("int") <= 12)
    out = CleaningPlan.load(spark, path).transform(batch, keep_rows=True)
    return out.select("o_orderkey", *[F.col(f"placed_{p}").cast("int").alias(f"placed_{p}") for p in ("year", "month", "day")])


@register("date_text_parts_orders",
          "SELECT o_orderkey, " + ", ".join(f"{p}(o_orderdate)::INTEGER AS {c}_{p}" for c in _DATE_TEXTS
                                            for p in ("year", "month", "day")) + " FROM orders")
def date_text_parts_orders(spark, sf_dir):
    """I1 on those texts: the parts of every date as it was written."""
    from loam.operators import features as FE
    df = FE.extract_datetime_features(_date_texts(spark, sf_dir), {c: "datetime" for c in _DATE_TEXTS})
    return df.select("o_orderkey", *[f"{c}_{p}" for c in _DATE_TEXTS for p in ("year", "month", "day")])
