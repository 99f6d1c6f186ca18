"""Golden micro-tables (hand-computed) and brute-force checks on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.functions.numeric_text import coerce_numeric, looks_numeric
from loam.functions.text import collapse_whitespace, standardize_names
from loam.operators import encode as ENC
from loam.operators import evaluate as EV
from loam.operators import features as FE
from loam.operators import missing as MIS
from loam.operators import outliers as OUT
from loam.operators import profile as P
from loam.operators.ordered import cumulative_sums
from loam.operators.quantiles import exact_quantiles, kth_smallest


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_moments(spark):
    df = _df(spark, [(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "x double")
    r = P.numeric_summary(df).first()
    assert r["mean"] == pytest.approx(4.0)
    assert r["median"] == pytest.approx(3.0)
    assert r["std"] == pytest.approx(3.559026, abs=1e-6)
    assert r["skew"] == pytest.approx(1.330938, abs=1e-6)
    assert r["kurtosis"] == pytest.approx(1.5, abs=1e-9)


def test_short_columns(spark):
    two = P.numeric_summary(_df(spark, [(1.0,), (3.0,)], "x double")).first()
    assert two["skew"] is None and two["kurtosis"] is None
    three = P.numeric_summary(_df(spark, [(1.0,), (3.0,), (8.0,)], "x double")).first()
    assert three["skew"] is not None and three["kurtosis"] is None


def test_constant_column(spark):
    df = _df(spark, [(5.0, float(i)) for i in range(5)], "k double, y double")
    assert OUT.detect_outliers(df, "zscore", 3.0, ["k"]).first()["n_outliers"] == 0
    assert OUT.remove_outliers(df, "zscore", 3.0, ["k"]).count() == 5
    corr = {(r["column_a"], r["column_b"]): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert corr[("k", "y")] is None
    s = P.numeric_summary(df, ["k"]).first()
    assert s["skew"] is None and s["kurtosis"] is None


def test_ties_mode_and_label_ranks(spark):
    df = _df(spark, [(v,) for v in ["b", "a", "B", "a", "b", "B"]], "c string")
    assert P.value_mode(df, ["c"]).first()["mode"] == "B"
    codes = {r["value"]: r["code"] for r in ENC.label_codes(df, "c").collect()}
    assert codes == {"B": 0, "a": 1, "b": 2}


def test_all_null_columns(spark):
    df = _df(spark, [(None, None), (None, None)], "s string, x double")
    types = {"s": "categorical", "x": "numeric"}
    plan = MIS.fit_imputation(df, types)
    fills = {c: v for c, _t, _m, _s, v in plan}
    assert fills["s"] is None and fills["x"] is None


NUMERIC_TEXT = [("$1,234.50", True, 1234.5), ("-5", True, -5.0), ("5%", True, 5.0), ("'7'", True, 7.0),
                ("1e5", False, 15.0), ("1234,567", False, 1234567.0), ("-$5", False, -5.0), ("", False, None),
                ("-", False, None)]


def test_numeric_text(spark):
    df = _df(spark, [(v,) for v, _a, _b in NUMERIC_TEXT], "v string")
    got = df.select("v", looks_numeric(F.col("v")).alias("ok"), coerce_numeric(F.col("v")).alias("x")).collect()
    got = {r["v"]: (r["ok"], r["x"]) for r in got}
    for v, ok, x in NUMERIC_TEXT:
        assert got[v] == (ok, x), v


def test_whitespace_collapse(spark):
    df = _df(spark, [("\ta   b  c \t",)], "s string")
    assert df.select(collapse_whitespace(F.col("s")).alias("s")).first()["s"] == "a b c"


def test_name_collisions():
    assert standardize_names(["Order Date", "order-date", "ORDER_DATE"]) == ["order_date", "order_date_2",
                                                                               "order_date_3"]


def test_exact_quantiles_with_hot_value(spark):
    rnd = random.Random(7)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [0.25] * 1500 + [None] * 20
    df = _df(spark, [(v, rnd.randint(0, 2)) for v in vals], "x double, g int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    arr = np.array([v for v in vals if v is not None])
    for direct_max in (0, 10_000_000):   # histogram narrowing, then the bounded percentile path
        got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], probs, cap=40, direct_max=direct_max).collect()}
        for p in probs:
            assert got[p] == pytest.approx(float(np.quantile(arr, p)), abs=1e-9)
    grouped = exact_quantiles(df, ["x"], [0.5], group_cols=["g"], cap=25, direct_max=1000).collect()
    pdf = pd.DataFrame({"x": vals, "g": [r for r in df.select("g").toPandas()["g"]]})
    for row in grouped:
        exp = pdf[pdf.g == row["g"]]["x"].dropna().quantile(0.5)
        assert row["value"] == pytest.approx(exp, abs=1e-12)
    assert kth_smallest(df, "x", 0) == pytest.approx(float(arr.min()))


def test_distributed_label_ranks(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcXYZé") for _ in range(rnd.randint(1, 6))) for _ in range(800)]
    df = _df(spark, [(w,) for w in words] + [(None,)], "w string")
    codes = {r["value"]: r["code"] for r in ENC.label_codes(df, "w", partitions=7).collect()}
    expected = {v: i for i, v in enumerate(sorted(set(words) | {"nan"}))}
    assert codes == expected


def test_cumulative_sums(spark):
    rnd = random.Random(5)
    rows = [(float(i) + rnd.random(), rnd.randint(0, 9)) for i in range(500)]
    df = _df(spark, rows, "k double, v long")
    got = {r["k"]: r["cum_v"] for r in cumulative_sums(df, "k", ["v"], partitions=6).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"]).sort_values("k")
    pdf["c"] = pdf["v"].cumsum()
    assert all(got[k] == c for k, c in zip(pdf["k"], pdf["c"]))


def test_split_invariants(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "key")
    train, test = FE.train_test_split(df, ["key"], 0.2, 42)
    tr = {r["key"] for r in train.collect()}
    te = {r["key"] for r in test.collect()}
    assert len(te) == math.ceil(0.2 * 1003)
    assert not (tr & te) and len(tr | te) == 1003
    _, test2 = FE.train_test_split(df.repartition(5), ["key"], 0.2, 42)
    assert {r["key"] for r in test2.collect()} == te


def _pandas_sequential_z(pdf, cols, t=3.0):
    out = pdf
    for c in cols:
        m, s = out[c].mean(), out[c].std()
        z = ((out[c] - m) / s).abs() if s and not math.isnan(s) else pd.Series(np.nan, index=out.index)
        out = out[(z <= t) | z.isna()]
    return out


def test_sequential_trimming_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.gauss(0, 1) + (25 if i % 97 == 0 else 0), rnd.gauss(5, 2) + (40 if i % 89 == 0 else 0))
            for i in range(2000)]
    pdf = pd.DataFrame(rows, columns=["id", "a", "b"])
    df = _df(spark, rows, "id long, a double, b double")
    got = sorted(r["id"] for r in OUT.remove_outliers(df, "zscore", 3.0, ["a", "b"]).collect())
    assert got == sorted(_pandas_sequential_z(pdf, ["a", "b"])["id"].tolist())
    simul = OUT.remove_outliers(df, "zscore", 3.0, ["a", "b"], mode="simultaneous").count()
    assert simul <= 2000


PRED = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.7), (1, 1, 0.7), (0, 0, 0.1), (1, 1, 0.8), (0, 0, 0.2)]


def test_prediction_metrics(spark):
    df = _df(spark, PRED, "label int, prediction int, score double")
    m = EV.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(6 / 8)
    # per class: 1 -> tp 3, predicted 4, support 4; 0 -> tp 3, predicted 4, support 4
    assert m["precision"] == pytest.approx(0.75) and m["recall"] == pytest.approx(0.75)
    pos = [s for y, _p, s in PRED if y == 1]
    neg = [s for y, _p, s in PRED if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert EV.roc_auc(df).first()["roc_auc"] == pytest.approx(brute)
    cm = {(r["label"], r["prediction"]): r["count"] for r in EV.confusion_matrix(df).collect()}
    assert cm == {(1, 1): 3, (1, 0): 1, (0, 0): 3, (0, 1): 1}
    pts = {r["threshold"]: (r["fpr"], r["tpr"]) for r in EV.roc_curve(df).collect()}
    assert pts[0.7] == (0.25, 0.75)


def test_iqr_detect_matches_pandas(spark):
    rnd = random.Random(2)
    xs = [rnd.expovariate(1.0) for _ in range(999)]
    df = _df(spark, [(x,) for x in xs], "x double")
    s = pd.Series(xs)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    exp = int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
    assert OUT.detect_outliers(df, "iqr").first()["n_outliers"] == exp


def test_approx_summary_close_to_exact(spark):
    rnd = random.Random(9)
    df = _df(spark, [(rnd.gauss(10, 3),) for _ in range(5000)], "x double")
    exact = P.numeric_summary(df).first()["median"]
    approx = P.numeric_summary(df, approx=True).first()["median"]
    assert abs(exact - approx) < 0.05


def test_wide_correlation_equals_pandas(spark):
    rnd = random.Random(13)
    cols = [f"c{i}" for i in range(12)]
    rows = [tuple([5.0] + [rnd.gauss(i, 1 + i) + 0.3 * k for i in range(1, 12)]) for k in range(300)]
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in
           P.correlation_matrix(_df(spark, rows, ", ".join(f"{c} double" for c in cols))).collect()}
    want = pd.DataFrame(rows, columns=cols).corr()
    assert len(got) == 144
    for (a, b), v in got.items():
        if "c0" in (a, b):
            assert v is None
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1e-9), (a, b)


def test_fixed2_matches_exact_binary_rounding(spark):
    from loam.functions.formatting import with_fixed2
    rnd = random.Random(4)
    vals = [256068.025, 0.125, 0.375, 2.675, 1.005, -1.005, -0.004, 0.0, -0.0, 123.455, 2.5]
    vals += [round(rnd.uniform(-1e6, 1e6), rnd.randint(0, 4)) for _ in range(3000)]
    vals += [(rnd.randint(0, 10 ** 8) + 0.5) / 100 for _ in range(1000)]
    df = _df(spark, [(v,) for v in vals], "x double")
    got = [r["s"] for r in with_fixed2(df, {"s": "x"}).select("s").collect()]
    assert got == [f"{v:.2f}" for v in vals]
