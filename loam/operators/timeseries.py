"""Time series over a timestamp and a value column (K1-K4).

The series is first aggregated to one row per period (a grouped aggregate,
partial aggregation before the shuffle); trend, seasonality and forecast then
work on that aggregated frame, whose size is the number of periods, not the
number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.stats import clean_double

FREQS = ("month", "day", "hour")
Z_95 = 1.959963984540054


def _period(t: Column, freq: str) -> Column:
    if freq not in FREQS:
        raise ValueError(f"unknown frequency: {freq}")
    return F.date_trunc(freq, t).cast("timestamp_ntz")


def _period_no(p: Column, freq: str) -> Column:
    """Whole periods since year 0 (an affine index: slopes are per period)."""
    if freq == "month":
        return F.year(p) * 12 + F.month(p) - 1
    if freq == "day":
        return F.unix_date(p.cast("date"))
    return F.floor(F.unix_seconds(p.cast("timestamp")) / 3600)


def _season(p: Column, freq: str) -> Column:
    if freq == "month":
        return F.month(p)
    if freq == "day":
        return F.weekday(p)
    return F.hour(p)


def resample(df: DataFrame, time_col: str, value_col: str, freq: str = "month", agg: str = "avg") -> DataFrame:
    """K1: ``(period, value, n)`` per calendar period."""
    fn = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
    p = _period(F.col(time_col), freq)
    return (df.where(F.col(time_col).isNotNull())
            .groupBy(p.alias("period"))
            .agg(fn(clean_double(F.col(value_col))).alias("value"), F.count(clean_double(F.col(value_col))).alias("n")))


def trend(series: DataFrame, freq: str = "month") -> DataFrame:
    """K2: ``(slope, intercept, direction)`` of a least-squares line over period numbers."""
    x = _period_no(F.col("period"), freq).cast("double")
    fit = series.agg(F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept"))
    direction = (F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
                 .otherwise("flat"))
    return fit.select("slope", "intercept", direction.alias("direction"))


def seasonal_indices(series: DataFrame, freq: str = "month") -> DataFrame:
    """K3: ``(season, index)``: mean value in each season position over the overall mean
    (month of year for monthly data, weekday for daily, hour for hourly)."""
    s = series.withColumn("season", _season(F.col("period"), freq))
    by = s.groupBy("season").agg(F.avg("value").alias("season_mean"))
    # the aggregated series is one row per period: a single ordered window is cheap
    overall = F.avg("season_mean").over(Window.partitionBy())
    return by.select("season", F.try_divide(F.col("season_mean"), overall).alias("index"))


def seasonality(series: DataFrame, freq: str = "month", tolerance: float = 0.1) -> DataFrame:
    """K3 label: ``seasonal`` when some index is more than ``tolerance`` away from 1."""
    idx = seasonal_indices(series, freq)
    return idx.agg(F.max(F.abs(F.col("index") - 1)).alias("amplitude")).select(
        "amplitude", F.when(F.col("amplitude") > tolerance, "seasonal").otherwise("none").alias("seasonality"))


def forecast(series: DataFrame, horizon: int = 6, freq: str = "month", z: float = Z_95) -> DataFrame:
    """K4: next ``horizon`` periods: linear trend times seasonal index, with a
    ``± z * residual std`` interval (residuals of the fitted history).

    The fit is four numbers read on the driver (slope, intercept, last
    period, residual std); future periods come from ``sequence`` + ``explode``.
    """
    x = _period_no(F.col("period"), freq).cast("double")
    hist = series.withColumn("x", x).withColumn("season", _season(F.col("period"), freq))
    idx = seasonal_indices(series, freq)
    fit = hist.agg(F.regr_slope("value", "x"), F.regr_intercept("value", "x"), F.max("period")).first()
    slope, intercept, last = fit[0] or 0.0, fit[1] or 0.0, fit[2]
    line = F.lit(intercept) + F.lit(slope) * F.col("x")
    sigma = (hist.join(idx, "season", "left")
             .agg(F.stddev_samp(F.col("value") - line * F.coalesce(F.col("index"), F.lit(1.0)))).first()[0])
    # from the ISO text, so no time zone is involved
    start = F.lit(last.isoformat(sep=" ")).cast("timestamp_ntz")
    k = F.col("k")
    if freq == "month":
        period = F.add_months(start, k).cast("timestamp_ntz")
    elif freq == "day":
        period = F.date_add(start.cast("date"), k).cast("timestamp_ntz")
    else:
        period = (start.cast("timestamp") + F.make_interval(hours=k)).cast("timestamp_ntz")
    future = (series.limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
              .withColumn("period", period))
    future = future.withColumn("x", _period_no(F.col("period"), freq).cast("double")) \
                   .withColumn("season", _season(F.col("period"), freq))
    out = future.join(idx, "season", "left").withColumn(
        "value", line * F.coalesce(F.col("index"), F.lit(1.0)))
    sg = F.lit(sigma if sigma is not None else None).cast("double")
    return out.select("period", "value", (F.col("value") - z * sg).alias("low"), (F.col("value") + z * sg).alias("high"))


# ---------------------------------------------------------------- many series

def resample_by(df: DataFrame, keys: list[str], time_col: str, value_col: str, freq: str = "day") -> DataFrame:
    """K1 per key: ``(keys..., x, value)``, x the number of the period, one row per key and period with a value.

    After this a key has at most as many rows as there are periods, however many rows it had.
    """
    x = _period_no(_period(F.col(time_col), freq), freq).cast("long")
    return (df.where(F.col(time_col).isNotNull()).groupBy(*keys, x.alias("x"))
            .agg(F.avg(clean_double(F.col(value_col))).alias("value")).where(F.col("value").isNotNull()))


def _same(keys: list[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return cond


def autocorrelations(series: DataFrame, keys: list[str], max_lag: int = 14) -> DataFrame:
    """``(keys..., lag, r, pairs)`` for lags 1 to ``max_lag`` of every series.

    r is the mean product of deviations of periods ``lag`` apart over the series' variance; periods
    without a value make no pair.  NULL where the series is constant.  Pairs meet in a join on
    (key, period), so neither a long series nor a border between partitions matters.
    """
    stats = series.groupBy(*keys).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    dev = series.alias("s").join(stats.alias("m"), _same(keys, "s", "m")).select(
        *[F.col(f"s.`{k}`").alias(k) for k in keys], "x", (F.col("value") - F.col("mean")).alias("d"), "var")
    ahead = dev.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "x", F.col("d").alias("e")) \
        .withColumn("x", F.col("x") + F.col("lag"))
    pairs = dev.alias("a").join(ahead.alias("b"), _same(keys, "a", "b") & (F.col("a.x") == F.col("b.x")))
    return (pairs.groupBy(*[F.col(f"a.`{k}`").alias(k) for k in keys], "lag")
            .agg(F.try_divide(F.avg(F.col("d") * F.col("e")), F.first("var")).alias("r"), F.count("*").alias("pairs")))


def season_lengths(acf: DataFrame, keys: list[str], z: float = Z_95) -> DataFrame:
    """K3 per key: ``(keys..., season, r)``; the lag from 2 on with the highest correlation that is
    significant (above z over the root of its pairs) and higher than at the lags beside it.
    Keys without such a lag have no row; the last lag given has no neighbour to be compared with.
    """
    near = Window.partitionBy(*keys).orderBy("lag")   # at most max_lag rows
    peaks = acf.withColumn("before", F.lag("r").over(near)).withColumn("after", F.lead("r").over(near)) \
        .withColumn("side", F.lag("lag").over(near)).withColumn("far", F.lead("lag").over(near)) \
        .where((F.col("lag") >= 2) & (F.col("side") == F.col("lag") - 1) & (F.col("far") == F.col("lag") + 1)
               & (F.col("r") > F.col("before")) & (F.col("r") >= F.col("after")) & (F.col("r") > z / F.sqrt("pairs")))
    best = peaks.groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("b"))
    return best.select(*keys, (-F.col("b.minus")).cast("int").alias("season"), F.col("b.r").alias("r"))


def forecast_by(series: DataFrame, keys: list[str], seasons: DataFrame, horizon: int = 7, z: float = Z_95) -> DataFrame:
    """K4 per key: ``(keys..., x, value, low, high)`` for the ``horizon`` periods after the last one.

    A least-squares line and, for keys in ``seasons`` (keys..., season), the mean deviation from it at
    each place in the season; the interval is z standard deviations of what is left.  Everything is
    grouped by key: no statistic of a series reaches the driver.
    """
    x, value = F.col("x").cast("double"), F.col("value")
    fit = series.groupBy(*keys).agg(F.coalesce(F.regr_slope(value, x), F.lit(0.0)).alias("slope"), F.avg(value).alias("mv"), F.avg(x).alias("mx"),
                                    F.max("x").alias("last"))
    fit = fit.alias("f").join(seasons.alias("s"), _same(keys, "f", "s"), "left").select(
        *[F.col(f"f.`{k}`").alias(k) for k in keys], "slope", "mv", "mx", "last", "season")
    line = F.col("mv") + F.col("slope") * (F.col("x") - F.col("mx"))
    phase = F.when(F.col("season").isNotNull(), F.pmod("x", "season"))
    past = series.alias("p").join(fit.alias("f"), _same(keys, "p", "f")).select(
        *[F.col(f"p.`{k}`").alias(k) for k in keys], "x", (value - line).alias("rest"), phase.alias("phase"))
    index = past.where("phase is not null").groupBy(*keys, "phase").agg(F.avg("rest").alias("index"))
    on = lambda a, b: _same(keys, a, b) & (F.col(f"{a}.phase") == F.col(f"{b}.phase"))
    sigma = past.alias("p").join(index.alias("i"), on("p", "i"), "left").groupBy(*[F.col(f"p.`{k}`").alias(k) for k in keys]).agg(
        F.stddev_samp(F.col("rest") - F.coalesce("index", F.lit(0.0))).alias("sigma"))
    future = fit.withColumn("x", F.explode(F.sequence(F.col("last") + 1, F.col("last") + horizon))).withColumn("line", line).withColumn("phase", phase)
    out = future.alias("u").join(index.alias("i"), on("u", "i"), "left").select(
        *[F.col(f"u.`{k}`").alias(k) for k in keys], "x", (F.col("line") + F.coalesce("index", F.lit(0.0))).alias("value"))
    out = out.alias("o").join(sigma.alias("g"), _same(keys, "o", "g"))
    return out.select(*[F.col(f"o.`{k}`").alias(k) for k in keys], "x", "value", (F.col("value") - z * F.col("sigma")).alias("low"),
                      (F.col("value") + z * F.col("sigma")).alias("high"))
