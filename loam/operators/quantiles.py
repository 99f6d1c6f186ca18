"""Exact quantiles without gathering a column into one task.

``F.median``/``F.percentile`` keep a value->count map per group and merge all
of it in one task; for a global aggregate over billions of near-unique doubles
that map is the whole column.  Here an order statistic is found by histogram
narrowing instead:

1. per key (optional group columns + column name): ``count``, ``min``, ``max``;
2. each wanted 0-based rank ``k`` starts with the range ``[min, max]``;
3. while a range still holds more than ``cap`` values, one aggregate pass counts
   the values of every open range in ``BUCKETS`` buckets (partial aggregation
   before the shuffle, so a hot key costs nothing extra), and the range shrinks
   to the bucket that holds rank ``k`` (its real min and max).  A range that spans
   zero or a factor over four has buckets by sign and logarithm, another one
   buckets of equal width: the first pass leaves a factor under 2.1, so less than
   54 bits, and every later pass takes 12 of them.  ``MAX_PASSES`` passes therefore
   end with single values for any data; nothing larger than ``cap`` is ever gathered;
4. a range with min = max is solved; the rest (at most ``cap`` values each)
   are sorted per target and the value at the rank is picked.

Without group columns sketches come first (``bracketed_ranks``): they bound every wanted value from both
sides, and one more scan counts the values in between; the narrowing above is what is left for very many
values or columns.

The targets table stays a DataFrame (checkpointed each pass), so the driver
holds no per-group state.  Interpolation follows the linear rule used by
pandas/numpy: ``h = (n-1)p``, ``x[floor h] + (h - floor h)(x[floor h + 1] - x[floor h])``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.stats import clean_double
from loam.session import materialise, remove, stored

BUCKETS = 4096
DEFAULT_CAP = 200_000
MAX_PASSES = 8
# Keys with at most this many values are sorted whole in one task (a bounded
# array) instead of being narrowed first.
DIRECT_MAX = 200_000


def long_values(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``columns`` to ``(group..., column_name, value double)``, missing dropped."""
    group_cols = list(group_cols)
    if not columns:
        raise ValueError("no columns to unpivot")
    cols = [clean_double(F.col(c)).alias(c) for c in columns]
    wide = df.select(*[F.col(g) for g in group_cols], *cols)
    return (wide.unpivot(group_cols, list(columns), "column_name", "value")
            .where(F.col("value").isNotNull()))


def _ranks(stats: DataFrame, probs: Sequence[float], keys: list[str]) -> DataFrame:
    """One row per (key, prob) with the two ranks to read and the weight between them."""
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    per_prob = (stats.where(F.col("n") > 0)
                .withColumn("prob", F.explode(prob_arr))
                .withColumn("h", (F.col("n") - 1) * F.col("prob"))
                .withColumn("k0", F.floor("h"))
                .withColumn("k1", F.least(F.col("k0") + 1, F.col("n") - 1))
                .withColumn("frac", F.col("h") - F.col("k0")))
    return per_prob.select(*keys, "prob", "k0", "k1", "frac", "n", "lo", "hi")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = (), cap: int = DEFAULT_CAP,
                    long: DataFrame | None = None, stats: DataFrame | None = None,
                    direct_max: int = DIRECT_MAX) -> DataFrame:
    """Exact quantiles: ``(group..., column_name, prob, value)``.

    Keys with no non-missing value give no row (callers left-join).  ``stats``
    may carry an already computed ``(keys..., n, lo, hi)`` frame.  Keys with at
    most ``direct_max`` values are sorted whole in one pass (a bounded array per
    key); larger keys go through histogram narrowing.
    """
    group_cols = list(group_cols)
    keys = group_cols + ["column_name"]
    data = long if long is not None else long_values(df, columns, group_cols)

    if stats is None:
        stats = materialise(data.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("lo"),
                                                    F.max("value").alias("hi")))
    small = not group_cols

    def side(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if small else t

    # keys with at most `direct_max` values: sort them per key (bounded) and read the ranks,
    # with the same interpolation as the narrowing path below
    small_ranks = _ranks(stats.where((F.col("n") > 0) & (F.col("n") <= direct_max)), probs, keys)
    direct_keys = small_ranks.select(*keys).distinct()
    direct = (data.join(side(direct_keys), on=keys, how="left_semi")
              .groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("vals"))
              .join(side(small_ranks.select(*keys, "prob", "k0", "k1", "frac")), on=keys)
              .select(*keys, "prob",
                      F.element_at("vals", (F.col("k0") + 1).cast("int")).alias("v0"),
                      F.element_at("vals", (F.col("k1") + 1).cast("int")).alias("v1"), "frac")
              .select(*keys, "prob", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("value")))
    big = stats.where(F.col("n") > direct_max)
    if big.limit(1).count() == 0:
        return direct
    per_prob = _ranks(big, probs, keys)
    wanted = per_prob.select(*keys, F.explode(F.array("k0", "k1")).alias("k"), "n", "lo", "hi").distinct()
    tv = bracketed_ranks(data, wanted) if small else None
    if tv is None:
        tv = solve_ranks(data, wanted, keys, cap, small=small)
    v0 = tv.select(*keys, F.col("k").alias("k0"), F.col("value").alias("v0"))
    v1 = tv.select(*keys, F.col("k").alias("k1"), F.col("value").alias("v1"))
    narrowed = (per_prob.join(v0, keys + ["k0"]).join(v1, keys + ["k1"])
                .select(*keys, "prob",
                        (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("value")))
    return direct.unionByName(narrowed)


# Rank error of the sketches as a share of the values, with room to spare, and the sketches' own setting.
SLACK, ACCURACY = 3e-4, 10_000
#: Distinct values inside all brackets that the driver may take; beyond that ranges are narrowed by jobs.
BRACKET_VALUES = 2_000_000
#: Columns whose brackets are written into one expression.
BRACKET_COLUMNS = 40


def bracketed_ranks(data: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """``solve_ranks`` for few columns in two scans: ``wanted`` (column_name, k, n, lo, hi), the result (column_name, k, value).

    Mergeable sketches bound each wanted value from both sides (one scan); values are then counted by
    zone, those inside a bracket by value (one scan, combined in the map tasks), and every rank is
    read off.  None where the columns or the values in brackets are too many, or a bracket missed.
    """
    ranks: dict[str, list[tuple[int, int]]] = {}
    for r in wanted.select("column_name", "k", "n").limit(64 * BRACKET_COLUMNS).collect():
        ranks.setdefault(r["column_name"], []).append((r["k"], r["n"]))
    if not ranks or len(ranks) > BRACKET_COLUMNS:
        return None
    probs = sorted({min(max(k / (n - 1) + s * SLACK, 0.0), 1.0) for rs in ranks.values() for k, n in rs for s in (-1, 1)})
    here = data.where(F.col("column_name").isin(*ranks))
    sketch = {r["column_name"]: dict(zip(probs, r["q"])) for r in here.groupBy("column_name").agg(
        F.percentile_approx("value", probs, ACCURACY).alias("q")).collect()}
    brackets: dict[str, list[list[float]]] = {}
    for c, rs in ranks.items():
        spans = sorted([sketch[c][min(max(k / (n - 1) + s * SLACK, 0.0), 1.0)] for s in (-1, 1)] for k, n in rs)
        merged = [spans[0]]
        for lo, hi in spans[1:]:
            if lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        brackets[c] = merged
    v, zone = F.col("value"), F.lit(None).cast("int")
    for c, spans in brackets.items():
        own = F.when(v < spans[0][0], 0)
        for i, (lo, hi) in enumerate(spans):
            own = own.when(v < lo, 2 * i).when(v <= hi, 2 * i + 1)
        zone = F.when(F.col("column_name") == c, own.otherwise(2 * len(spans))).otherwise(zone)
    counts, path = stored(here.withColumn("zone", zone).groupBy(
        "column_name", "zone", F.when(F.col("zone") % 2 == 1, v).alias("v")).agg(F.count("*").alias("n")))
    try:
        if counts.count() > BRACKET_VALUES:
            return None
        held: dict[str, list[tuple]] = {}
        for r in counts.collect():
            held.setdefault(r["column_name"], []).append((r["zone"], r["v"] if r["v"] is not None else 0.0, r["n"]))
    finally:
        remove(data.sparkSession, path)
    out = []
    for c, rs in ranks.items():
        rows = sorted(held.get(c, []))
        ends = np.cumsum([n for _, _, n in rows])
        for k, _ in rs:
            at = int(np.searchsorted(ends, k, "right"))
            if at == len(rows) or rows[at][0] % 2 == 0:
                return None
            out.append((c, k, float(rows[at][1])))
    return data.sparkSession.createDataFrame(out, "column_name string, k long, value double")


def kth_smallest(df: DataFrame, column: str, k: int, cap: int = DEFAULT_CAP) -> float | None:
    """Exact value of 0-based rank ``k`` among the non-missing values of ``column``."""
    data = long_values(df, [column])
    stats = materialise(data.groupBy("column_name").agg(F.count("value").alias("n"), F.min("value").alias("lo"),
                                                        F.max("value").alias("hi")))
    wanted = stats.where(F.lit(k) < F.col("n")).select("column_name", F.lit(k).cast("long").alias("k"),
                                                       "n", "lo", "hi")
    row = solve_ranks(data, wanted, ["column_name"], cap, small=True).first()
    return None if row is None else row["value"]


def solve_ranks(data: DataFrame, wanted: DataFrame, keys: list[str], cap: int = DEFAULT_CAP,
                small: bool = True) -> DataFrame:
    """Value at each wanted rank: ``wanted`` has ``(keys..., k, n, lo, hi)``; returns ``(keys..., k, value)``.

    ``small`` says the wanted table has a size bound independent of the data
    (no group columns), so it may be broadcast; otherwise the planner decides
    and AQE splits skewed join partitions.
    """
    def side(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if small else t

    # the target id is the (key..., rank) struct itself: exact, no hash collisions
    targets = (wanted.withColumn("tid", F.struct(*[F.col(c) for c in keys], F.col("k")))
               .select("tid", *keys, "k", "lo", "hi", F.lit(0).cast("long").alias("below"),
                       F.col("n").alias("cnt")))
    for i in range(MAX_PASSES + 1):
        open_t = targets.where((F.col("cnt") > cap) & (F.col("lo") < F.col("hi")))
        if open_t.isEmpty():
            break
        if i == MAX_PASSES:
            raise RuntimeError("a range still holds more values than may be gathered")
        # first pass: every target of a key still spans the key's [min, max], so
        # one histogram per key serves them all
        targets = materialise(_narrow(data, targets, open_t, keys, side, per_key=(i == 0)))

    # degenerate ranges are solved; the rest sort at most `cap` values per target
    single = targets.where(F.col("lo") == F.col("hi")).select("tid", F.col("lo").alias("value"))
    rest = targets.where(F.col("lo") < F.col("hi")).select("tid", *keys, "lo", "hi", "below", "k")
    picked = (_in_key_ranges(data, rest, keys, side).join(side(rest), on=keys)
              .where(F.col("value").between(F.col("lo"), F.col("hi")))
              .groupBy("tid", "k", "below")
              .agg(F.sort_array(F.collect_list("value")).alias("vals"))
              .select("tid", F.element_at("vals", (F.col("k") - F.col("below") + 1).cast("int"))
                      .alias("value")))
    solved = single.unionByName(picked)
    return targets.select("tid", *keys, "k").join(solved, "tid").drop("tid")


def _in_key_ranges(data: DataFrame, t: DataFrame, keys: list[str], side) -> DataFrame:
    """Rows inside the union span of their key's open ranges (drops most rows before
    the per-target join, which repeats a row once per target of its key)."""
    spans = t.groupBy(*keys).agg(F.min("lo").alias("_klo"), F.max("hi").alias("_khi"))
    return (data.join(side(spans), on=keys).where(F.col("value").between(F.col("_klo"), F.col("_khi")))
            .drop("_klo", "_khi"))


def _bucket():
    """Bucket of ``value`` in its range ``lo`` to ``hi``; grows with the value."""
    half_span = F.col("hi") / 2 - F.col("lo") / 2
    even = F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / half_span * BUCKETS), F.lit(BUCKETS - 1))
    half = BUCKETS // 2
    # place of a magnitude between the smallest and the largest double
    size = F.least(F.greatest(F.floor((F.log2(F.abs("value")) + 1075) / 2100 * (half - 1)), F.lit(0)), F.lit(half - 2))
    signed = F.when(F.col("value") > 0, F.lit(half + 1) + size).when(F.col("value") < 0, F.lit(half - 1) - size) \
        .otherwise(F.lit(half))
    wide = ((F.col("lo") <= 0) & (F.col("hi") >= 0)) | (F.greatest(F.abs("lo"), F.abs("hi")) / 4
                                                       > F.least(F.abs("lo"), F.abs("hi")))
    return F.when(wide, signed).otherwise(even).cast("int")


def _narrow(data: DataFrame, targets: DataFrame, open_t: DataFrame, keys: list[str], side,
            per_key: bool = False) -> DataFrame:
    """One histogram pass over every open range; returns the updated targets."""
    bucket = _bucket()
    if per_key:
        ranges = open_t.select(*keys, "lo", "hi").distinct()
        part = keys
        hist = (data.join(side(ranges), on=keys)
                .where(F.col("value").between(F.col("lo"), F.col("hi")))
                .withColumn("bucket", bucket)
                .groupBy(*keys, "bucket")
                .agg(F.count("*").alias("b_cnt"), F.min("value").alias("b_lo"), F.max("value").alias("b_hi")))
    else:
        part = ["tid"]
        hist = (_in_key_ranges(data, open_t, keys, side).join(side(open_t.select("tid", *keys, "lo", "hi")), on=keys)
                .where(F.col("value").between(F.col("lo"), F.col("hi")))
                .withColumn("bucket", bucket)
                .groupBy("tid", "bucket")
                .agg(F.count("*").alias("b_cnt"), F.min("value").alias("b_lo"), F.max("value").alias("b_hi")))
    w = Window.partitionBy(*part).orderBy("bucket")
    hist = hist.withColumn("upto", F.sum("b_cnt").over(w)).withColumn("before", F.col("upto") - F.col("b_cnt"))
    chosen = (hist.join(open_t.select("tid", *part if per_key else [], "k", "below"), part)
              .where((F.col("below") + F.col("before") <= F.col("k"))
                     & (F.col("k") < F.col("below") + F.col("upto")))
              .select("tid", F.col("b_lo").alias("n_lo"), F.col("b_hi").alias("n_hi"),
                      (F.col("below") + F.col("before")).alias("n_below"), F.col("b_cnt").alias("n_cnt")))
    return (targets.join(chosen, "tid", "left")
            .select("tid", *keys, "k",
                    F.coalesce("n_lo", "lo").alias("lo"), F.coalesce("n_hi", "hi").alias("hi"),
                    F.coalesce("n_below", "below").alias("below"), F.coalesce("n_cnt", "cnt").alias("cnt")))


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                 cap: int = DEFAULT_CAP) -> dict[tuple[str, float], float | None]:
    """Driver-side dict ``{(column, prob): value}``: bounded by columns x probs."""
    if not columns:
        return {}
    rows = exact_quantiles(df, columns, probs, cap=cap).collect()
    out = {(c, float(p)): None for c in columns for p in probs}
    for r in rows:
        out[(r["column_name"], float(r["prob"]))] = r["value"]
    return out


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     group_cols: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch alternative (bounded sketch per key); same output shape."""
    keys = list(group_cols) + ["column_name"]
    data = long_values(df, columns, group_cols)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    q = data.groupBy(*keys).agg(F.percentile_approx("value", arr, accuracy).alias("qs"))
    return (q.select(*keys, F.posexplode("qs").alias("i", "value"))
            .withColumn("prob", arr[F.col("i")]).drop("i")
            .select(*keys, "prob", "value"))
