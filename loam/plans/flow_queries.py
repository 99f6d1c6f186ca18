"""Checkable end-to-end queries: cleaning flow (M11), report (M9), time series
(K1-K4), and source/sink round trips (A1, A2, A4-A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import profile as P
from loam.operators import semantic_types as ST
from loam.operators import timeseries as TS
from loam.plans.cleaning import CleaningPlan
from loam.plans.cleaning_queries import _UNICODE_WS
from loam.plans.feature_queries import SEGMENT_VALUES, STATUS_VALUES, _onehot_sql
from loam.plans.profile_queries import _summary_sql
from loam.plans.registry import r, register, rounded, table
from loam.plans.report import eda_report
from loam.sources import readers, sinks

# ----------------------------------------------------------------- M11 flagship


def orders_customers_faulty(spark, sf_dir):
    """orders joined to customers, with missing balances, padded segments and repeated rows."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_name",
        F.when(k % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 5 == 0, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  "))).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"))
    return j.unionAll(j.where(k % 10 == 0))


_FLOW_NUM = ["o_orderkey", "o_custkey", "o_totalprice", "c_acctbal"]


def _flagship_sql(distinct: bool = True) -> str:
    ws = _UNICODE_WS
    det = " + ".join(f"(SELECT count_if(abs(({c} - m) / nullif(s, 0)) > 3.0) FROM f, "
                     f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM f))" for c in _FLOW_NUM)
    trims = []
    for i, c in enumerate(_FLOW_NUM):
        trims.append(f"t{i + 1} AS (SELECT t{i}.* FROM t{i}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM t{i}) st "
                     f"WHERE (SELECT n FROM det) = 0 OR coalesce(abs(({c} - st.m) / nullif(st.s, 0)) <= 3.0, true))")
    text = ", ".join(f"trim(regexp_replace({c}, '{ws}', ' ', 'g')) AS {c}"
                     for c in ["o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment"])
    last = f"t{len(_FLOW_NUM)}"
    return f"""WITH base AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
  o.o_orderpriority, c.c_name, CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS c_acctbal,
  CASE WHEN o.o_orderkey % 5 = 0 THEN '  ' || c.c_mktsegment || '  ' ELSE c.c_mktsegment END AS c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
d AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 10 = 0),
f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_name,
  coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM d)) AS c_acctbal, c_mktsegment FROM d),
det AS (SELECT {det} AS n),
t0 AS (SELECT * FROM f),
{", ".join(trims)},
x AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, c_acctbal, {text} FROM {last}),
y AS (SELECT {"DISTINCT" if distinct else ""} * FROM x)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_name,
  {r('c_acctbal')} AS c_acctbal, c_mktsegment,
  {_onehot_sql('o_orderstatus', STATUS_VALUES)},
  dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS o_orderpriority_encoded,
  dense_rank() OVER (ORDER BY coalesce(c_name, 'nan')) - 1 AS c_name_encoded,
  {_onehot_sql('c_mktsegment', SEGMENT_VALUES)},
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter
FROM y"""


@register("clean_dataset_orders_customer", _flagship_sql())
def clean_dataset_orders_customer(spark, sf_dir):
    """The whole cleaning flow with target o_orderpriority on faulty orders x customers."""
    _plan, cleaned = CleaningPlan(target="o_orderpriority").fit(orders_customers_faulty(spark, sf_dir))
    return cleaned.withColumn("c_acctbal", F.round("c_acctbal", 4))


@register("cleaning_plan_reapplied", _flagship_sql())
def cleaning_plan_reapplied(spark, sf_dir):
    """M11 transform: a plan fitted on the faulty input re-applied lazily to the same input
    (no statistic recomputed); the rows equal the fitted output."""
    src = orders_customers_faulty(spark, sf_dir)
    plan, _cleaned = CleaningPlan(target="o_orderpriority").fit(src)
    return plan.transform(src).withColumn("c_acctbal", F.round("c_acctbal", 4))


@register("eda_report_customer")
def eda_report_customer(spark, sf_dir):
    """M9: report content (overview, types, missing, numeric and categorical summaries, steps)."""
    src = orders_customers_faulty(spark, sf_dir)
    plan, _cleaned = CleaningPlan(target="o_orderpriority").fit(src)
    return eda_report(src, ST.column_types(src), plan.log_frame(spark))


@register("streaming_clean_orders_customer", _flagship_sql(distinct=False))
def streaming_clean_orders_customer(spark, sf_dir):
    """M11 on a stream: the faulty input is landed as Parquet files, read back as a file
    stream, cleaned by the batch-fitted plan and written by a streaming Parquet sink."""
    from loam.streaming.clean_stream import clean_stream, read_parquet_stream, run_available
    src = orders_customers_faulty(spark, sf_dir)
    plan, _cleaned = CleaningPlan(target="o_orderpriority").fit(src)
    landing = sinks.new_output_path(spark, "landing")
    src.write.parquet(landing)
    # a batch has a file for every core
    stream = read_parquet_stream(spark, landing, src.schema, max_files=max(1, spark.sparkContext.defaultParallelism))
    out = run_available(clean_stream(plan, stream))
    return spark.read.parquet(out).withColumn("c_acctbal", F.round("c_acctbal", 4))


# ----------------------------------------------------------------- K1-K4

_MONTHLY_SQL = ("(SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, avg(o_totalprice) AS value, "
                "count(o_totalprice) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)")
_X_SQL = "(year(period) * 12 + month(period) - 1)"


def monthly_orders(spark, sf_dir):
    return TS.resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "month")


@register("monthly_values_orders", f"SELECT period, {r('value')} AS value, n FROM {_MONTHLY_SQL}")
def monthly_values_orders(spark, sf_dir):
    """K1: mean order value per calendar month."""
    return rounded(monthly_orders(spark, sf_dir))


@register("trend_orders", f"SELECT {r(f'regr_slope(value, {_X_SQL})')} AS slope, "
          f"{r(f'regr_intercept(value, {_X_SQL})', 2)} AS intercept, CASE WHEN regr_slope(value, {_X_SQL}) > 0 "
          f"THEN 'increasing' WHEN regr_slope(value, {_X_SQL}) < 0 THEN 'decreasing' ELSE 'flat' END AS direction "
          f"FROM {_MONTHLY_SQL}")
def trend_orders(spark, sf_dir):
    """K2: least-squares trend of the monthly series and its direction."""
    t = TS.trend(monthly_orders(spark, sf_dir), "month")
    return rounded(t.withColumn("intercept", F.round("intercept", 2)))


@register("seasonal_indices_orders",
          f"SELECT season, {r('season_mean / avg(season_mean) OVER ()')} AS index FROM "
          f"(SELECT CAST(month(period) AS INTEGER) AS season, avg(value) AS season_mean FROM {_MONTHLY_SQL} GROUP BY 1)")
def seasonal_indices_orders(spark, sf_dir):
    """K3: month-of-year index of the monthly series."""
    return rounded(TS.seasonal_indices(monthly_orders(spark, sf_dir), "month"))


_DAILY_SQL = ("(SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, avg(value) AS value, count(value) AS n "
              "FROM events WHERE ts IS NOT NULL GROUP BY 1)")


@register("seasonality_events",
          f"SELECT {r('max(abs(index - 1))')} AS amplitude, CASE WHEN max(abs(index - 1)) > 0.1 THEN 'seasonal' "
          f"ELSE 'none' END AS seasonality FROM (SELECT season_mean / avg(season_mean) OVER () AS index FROM "
          f"(SELECT isodow(period) - 1 AS season, avg(value) AS season_mean FROM {_DAILY_SQL} GROUP BY 1))")
def seasonality_events(spark, sf_dir):
    """K1 + K3: daily mean event value, weekday indices and the seasonality label."""
    series = TS.resample(table(spark, sf_dir, "events"), "ts", "value", "day")
    return rounded(TS.seasonality(series, "day"))


_USER_DAYS = """d AS (SELECT user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS x, avg(value) AS value FROM events
  WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
m AS (SELECT user_id, avg(value) AS mean, var_pop(value) AS var FROM d GROUP BY 1),
acf AS (SELECT a.user_id, b.x - a.x AS lag, avg((a.value - mean) * (b.value - mean)) / nullif(any_value(var), 0) AS r, count(*) AS pairs
  FROM d a JOIN d b ON a.user_id = b.user_id AND b.x - a.x BETWEEN 1 AND 12 JOIN m ON m.user_id = a.user_id GROUP BY 1, 2),
n AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after, lag(lag) OVER w AS side, lead(lag) OVER w AS far FROM acf
  WINDOW w AS (PARTITION BY user_id ORDER BY lag)),
sl AS (SELECT user_id, arg_max(lag, (r, -lag)) AS season, max(r) AS r FROM n WHERE lag >= 2 AND side = lag - 1 AND far = lag + 1
  AND r > before AND r >= after AND r > 1.959963984540054 / sqrt(pairs) GROUP BY 1)"""


def _user_days(spark, sf_dir):
    return TS.resample_by(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", "day")


@register("autocorrelation_events_by_user", f"WITH {_USER_DAYS} SELECT user_id, lag::INTEGER AS lag, {r('r')} AS r, pairs FROM acf")
def autocorrelation_events_by_user(spark, sf_dir):
    """K3 for many series: autocorrelation of each user's daily means at lags of 1 to 12 days."""
    return rounded(TS.autocorrelations(_user_days(spark, sf_dir), ["user_id"], 12))


@register("season_lengths_events_by_user", f"WITH {_USER_DAYS} SELECT user_id, season::INTEGER AS season, {r('r')} AS r FROM sl")
def season_lengths_events_by_user(spark, sf_dir):
    """K3 for many series: the season that each user's days show, of any length, where they show one."""
    return rounded(TS.season_lengths(TS.autocorrelations(_user_days(spark, sf_dir), ["user_id"], 12), ["user_id"]))


@register("forecast_events_by_user", f"""WITH {_USER_DAYS},
f AS (SELECT user_id, coalesce(regr_slope(value, x), 0) AS slope, avg(value) AS mv, avg(x) AS mx, max(x) AS last, any_value(season) AS season
  FROM d LEFT JOIN sl USING (user_id) GROUP BY 1),
p AS (SELECT user_id, x, value - (mv + slope * (x - mx)) AS rest, x % season AS phase FROM d JOIN f USING (user_id)),
i AS (SELECT user_id, phase, avg(rest) AS index FROM p WHERE phase IS NOT NULL GROUP BY 1, 2),
g AS (SELECT p.user_id, stddev_samp(rest - coalesce(index, 0)) AS sigma FROM p LEFT JOIN i USING (user_id, phase) GROUP BY 1),
u AS (SELECT *, unnest(range(last + 1, last + 8)) AS x FROM f),
o AS (SELECT u.user_id, u.x, mv + slope * (u.x - mx) + coalesce(index, 0) AS value FROM u LEFT JOIN i ON i.user_id = u.user_id AND i.phase = u.x % season)
SELECT user_id, x, {r('value', 2)} AS value, {r('value - 1.959963984540054 * sigma', 2)} AS low,
  {r('value + 1.959963984540054 * sigma', 2)} AS high FROM o JOIN g USING (user_id)""")
def forecast_events_by_user(spark, sf_dir):
    """K4 for many series: a week ahead for every user, with the season that the user's own days show."""
    days = _user_days(spark, sf_dir)
    seasons = TS.season_lengths(TS.autocorrelations(days, ["user_id"], 12), ["user_id"]).select("user_id", "season")
    return rounded(TS.forecast_by(days, ["user_id"], seasons), 2)


@register("daily_values_events", f"SELECT period, {r('value')} AS value, n FROM {_DAILY_SQL}")
def daily_values_events(spark, sf_dir):
    """K1 at daily frequency on the event stream table."""
    return rounded(TS.resample(table(spark, sf_dir, "events"), "ts", "value", "day"))


_FORECAST_SQL = f"""WITH s AS (SELECT *, {_X_SQL} AS x, month(period) AS season FROM {_MONTHLY_SQL}),
idx AS (SELECT season, season_mean / avg(season_mean) OVER () AS ix FROM (SELECT season, avg(value) AS season_mean FROM s GROUP BY 1)),
fit AS (SELECT regr_slope(value, x) AS b, regr_intercept(value, x) AS a, max(period) AS last FROM s),
sig AS (SELECT stddev_samp(value - (a + b * x) * coalesce(ix, 1.0)) AS sigma FROM s LEFT JOIN idx USING (season), fit),
fut AS (SELECT CAST(last + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS period FROM fit, range(1, 7) t(k)),
v AS (SELECT period, (a + b * {_X_SQL}) * coalesce(ix, 1.0) AS value FROM fut LEFT JOIN idx ON month(fut.period) = idx.season, fit)
SELECT period, {r('value', 2)} AS value, {r('value - 1.959963984540054 * sigma', 2)} AS low,
  {r('value + 1.959963984540054 * sigma', 2)} AS high FROM v, sig"""


@register("forecast_orders", _FORECAST_SQL)
def forecast_orders(spark, sf_dir):
    """K4: six-month forecast (trend x seasonal index) with a 95% interval."""
    return rounded(TS.forecast(monthly_orders(spark, sf_dir), 6, "month"), 2)


# ----------------------------------------------------------------- sources and sinks


@register("csv_roundtrip_customer",
          "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip_customer(spark, sf_dir):
    """A6 then A1/A3: cleaned-table CSV sink, read back with header and inferred types."""
    path = sinks.save_cleaned(table(spark, sf_dir, "customer"), sinks.new_output_path(spark, "customer") + ".csv")
    return readers.load(spark, path)


@register("csv_roundtrip_documents", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark, sf_dir):
    """A6 then A1: texts with line breaks, quotes and padding come back as they were (empty ones as missing)."""
    path = sinks.save_cleaned(table(spark, sf_dir, "documents"), sinks.new_output_path(spark, "documents") + ".csv")
    return readers.load(spark, path, multi_line=True)


@register("csv_roundtrip_conversations", "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations")
def csv_roundtrip_conversations(spark, sf_dir):
    """A6 then A1 on conversation turns."""
    path = sinks.save_cleaned(table(spark, sf_dir, "conversations"), sinks.new_output_path(spark, "turns") + ".csv")
    return readers.load(spark, path, multi_line=True)


@register("csv_missing_tokens_orders",
          "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN NULL ELSE o_totalprice END AS price, "
          "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def csv_missing_tokens_orders(spark, sf_dir):
    """A1: NA, n/a and null fields are missing, and the column around them is numeric."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, "NA").when(k % 7 == 1, "n/a").when(k % 7 == 2, "null").otherwise(F.col("o_totalprice").cast("string"))
    raw = o.select("o_orderkey", price.alias("price"), F.when(k % 5 == 0, "None").otherwise(F.col("o_orderpriority")).alias("priority"))
    path = sinks.save_cleaned(raw, sinks.new_output_path(spark, "tokens") + ".csv")
    return readers.load(spark, path)


@register("json_roundtrip_orders",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def json_roundtrip_orders(spark, sf_dir):
    """A2/A3: JSON-lines sink and scan with inferred types."""
    o = table(spark, sf_dir, "orders").drop("o_orderdate")
    path = sinks.save_cleaned(o, sinks.new_output_path(spark, "orders") + ".json", fmt="json")
    return readers.load(spark, path).select(*o.columns)


@register("json_array_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def json_array_conversations(spark, sf_dir):
    """A2: array documents of all turns; each file is read in blocks, its records found by their depth."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = sinks.save_cleaned(turns, sinks.new_output_path(spark, "turns") + ".json", fmt="json_array")
    return readers.load(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in turns.schema.fields])


@register("string_load_customer",
          "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
          "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer")
def string_load_customer(spark, sf_dir):
    """A4: every column loaded as text."""
    path = sinks.save_cleaned(table(spark, sf_dir, "customer"), sinks.new_output_path(spark, "cust") + ".csv")
    return readers.load(spark, path, all_strings=True)


@register("snapshot_restore_orders", "SELECT * FROM orders")
def snapshot_restore_orders(spark, sf_dir):
    """A5: Parquet snapshot written and restored."""
    path = sinks.write_snapshot(table(spark, sf_dir, "orders"))
    return spark.read.parquet(path)


@register("analysis_results_part", _summary_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def analysis_results_part(spark, sf_dir):
    """Tidy analysis results written as JSON and read back."""
    summary = rounded(P.numeric_summary(table(spark, sf_dir, "part")))
    path = sinks.save_results({"numeric_summary": summary})
    back = spark.read.schema(summary.schema).json(f"{path}/numeric_summary")
    return back


def _eda_report_sql() -> str:
    from loam.plans.cleaning_queries import _types_sql
    src = ("(SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority, "
           "c.c_name, CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS c_acctbal, "
           "CASE WHEN o.o_orderkey % 5 = 0 THEN '  ' || c.c_mktsegment || '  ' ELSE c.c_mktsegment END AS c_mktsegment "
           "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
           "UNION ALL SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, "
           "o.o_orderpriority, c.c_name, CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END, "
           "CASE WHEN o.o_orderkey % 5 = 0 THEN '  ' || c.c_mktsegment || '  ' ELSE c.c_mktsegment END "
           "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey % 10 = 0)")
    cols = [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "string"),
            ("o_totalprice", "number"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
            ("c_name", "string"), ("c_acctbal", "number"), ("c_mktsegment", "string")]
    types = _types_sql("src", cols)
    pos = " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _k) in enumerate(cols))
    nums = [c for c, k in cols if k == "number"]
    strs = [c for c, k in cols if k == "string"]
    f2 = "printf('%.2f', {e})"
    num = " UNION ALL ".join(
        f"SELECT 'numeric summary' AS section, 0 AS position, '{c}' AS item, 'Mean: ' || {f2.format(e=f'avg({c})')} || "
        f"', Median: ' || {f2.format(e=f'quantile_cont({c}, 0.5)')} || ', Std: ' || {f2.format(e=f'stddev_samp({c})')} || "
        f"', Min: ' || {f2.format(e=f'CAST(min({c}) AS DOUBLE)')} || ', Max: ' || {f2.format(e=f'CAST(max({c}) AS DOUBLE)')} || "
        f"', Skew: ' || {f2.format(e=f'skewness({c})')} AS value FROM src" for c in nums)
    vc = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM src WHERE {c} IS NOT NULL "
                            f"GROUP BY {c}" for c in strs)
    miss = " UNION ALL ".join(f"SELECT '{c}' AS c, count_if({c} IS NULL) AS m FROM src" for c, _k in cols)
    return f"""WITH src AS {src},
vc AS ({vc}),
u AS (SELECT column_name, count(*) AS uq FROM vc GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS rk FROM vc)
SELECT 'overview' AS section, 0 AS position, 'shape' AS item, 'Rows: ' || CAST(count(*) AS VARCHAR) || ', Columns: 9' AS value FROM src
UNION ALL SELECT 'column types', CASE column_name {pos} END, column_name, semantic_type FROM ({types})
UNION ALL SELECT 'missing values', 0, c, CAST(m AS VARCHAR) || ' missing values' FROM ({miss}) WHERE m > 0
UNION ALL {num}
UNION ALL SELECT 'categorical summary', rk, r.column_name, CAST(uq AS VARCHAR) || ' unique; ' || value || ': ' || CAST(cnt AS VARCHAR)
  FROM r JOIN u USING (column_name) WHERE rk <= 5"""


@register("eda_report_sections_orders_customer", _eda_report_sql())
def eda_report_sections_orders_customer(spark, sf_dir):
    """M9 without the cleaning log: overview, detected types, missing counts, numeric and
    categorical summaries of the faulty orders x customers input."""
    src = orders_customers_faulty(spark, sf_dir)
    return eda_report(src, ST.column_types(src))
