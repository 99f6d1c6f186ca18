"""CSV as users have it, correlations in one scan, quantiles of any range, odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions.formatting import with_fixed2
from loam.functions.hashing import seeded_hash52
from loam.operators import evaluate as EV
from loam.operators import profile as P
from loam.operators import quantiles as Q
from loam.sources import readers, sinks


def test_csv_quotes_newlines_padding_and_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,text,x\n1,"say ""hi"", ok",1.5\n2,"two\nlines",NA\n3," pad ",n/a\n4,NULL,2\n')
    df = readers.load(spark, str(p), multi_line=True)
    rows = {r["id"]: (r["text"], r["x"]) for r in df.collect()}
    assert rows == {1: ('say "hi", ok', 1.5), 2: ("two\nlines", None), 3: (" pad ", None), 4: (None, 2.0)}
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "x": "double"}
    assert dict(readers.load(spark, str(p), multi_line=True, all_strings=True).dtypes)["x"] == "string"
    typed = readers.load(spark, str(p), schema="id int, text string, x float", multi_line=True)
    assert dict(typed.dtypes) == {"id": "int", "text": "string", "x": "float"} and typed.count() == 4


def test_csv_sink_round_trip(spark, tmp_path):
    rows = [(1, ' a "b", c '), (2, "line\nbreak"), (3, None), (4, "back\\slash"), (5, "5")]
    path = sinks.save_cleaned(spark.createDataFrame(rows, "k long, s string"), str(tmp_path / "o.csv"))
    got = readers.load(spark, path, multi_line=True)
    assert sorted(map(tuple, got.collect())) == rows


def test_csv_names_with_dots(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("unit.price,b\n1,x\n2,y\n")
    assert readers.load(spark, str(p)).columns == ["unit.price", "b"]


def test_correlation_scans_once_for_any_width(spark, tmp_path):
    rng = np.random.default_rng(0)
    plans = {}
    for k in (8, 100):
        x = rng.normal(size=(200, k)) + 1e6
        x[rng.random(x.shape) < 0.1] = np.nan
        x[:, 1] = 5.0
        cols = [f"v{i}" for i in range(k)]
        spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x],
                              ", ".join(f"{c} double" for c in cols)).write.parquet(str(tmp_path / f"w{k}"))
        df = spark.read.parquet(str(tmp_path / f"w{k}"))
        out = P.correlation_matrix(df, cols)
        plans[k] = out._jdf.queryExecution().executedPlan().toString().count("FileScan")
        got = {(r.column_a, r.column_b): r["corr"] for r in out.collect()}
        assert len(got) == k * k
        assert got["v0", "v1"] is None
        for a, b in (("v0", "v2"), ("v3", "v7")):
            i, j = int(a[1:]), int(b[1:])
            m = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert math.isclose(got[a, b], np.corrcoef(x[m, i], x[m, j])[0, 1], rel_tol=1e-8, abs_tol=1e-10)
    assert plans[8] == plans[100] == 1


def test_quantiles_of_log_spaced_values(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(2500)] + [0.0] * 50 + [7.0] * 400
    passes = []
    real = Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a, **k: passes.append(1) or real(*a, **k))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Q.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], cap=20, direct_max=20).collect()
    want = dict(zip((0.1, 0.5, 0.9), np.quantile(values, [0.1, 0.5, 0.9])))
    assert all(math.isclose(r["value"], want[r["prob"]], rel_tol=1e-9) for r in got) and len(got) == 3
    assert len(passes) <= 6


def test_tables_without_numeric_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert P.histogram(df).count() == 0 and P.target_correlation(df, "s").count() == 0
    assert P.correlation_matrix(df).count() == 0


def test_auc_totals_are_doubles(spark):
    big = spark.createDataFrame([(1.0, 0.5), (0.0, 0.25)], "label double, score double")
    assert EV.roc_auc(big).first()[0] == 1.0
    assert "double" in EV.roc_auc(big).dtypes[0][1]


def test_fixed_text_of_large_values(spark):
    values = [123456789012345.67, 1e18, 99999999999999.996, 0.125, -12345678901234.5, 1e13]
    df = with_fixed2(spark.createDataFrame([(v,) for v in values], "x double"), {"s": "x"})
    assert {r.x: r.s for r in df.collect()} == {v: f"{v:.2f}" for v in values}


def test_key_parts_do_not_run_together(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None)], "p string, q string")
    assert df.select(seeded_hash52(["p", "q"]).alias("h")).distinct().count() == 4


def test_class_balance_needs_no_common_window(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("y"))
    out = P.class_balance(df, "y")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["share"] for r in out.collect()} == {0.25}


@pytest.mark.parametrize("text,numeric", [("5", True), ("5\n", False), ("$1,234.50", True)])
def test_numeric_text_is_a_full_match(spark, text, numeric):
    from loam.functions.numeric_text import looks_numeric
    assert spark.createDataFrame([(text,)], "s string").select(looks_numeric(F.col("s"))).first()[0] is numeric
