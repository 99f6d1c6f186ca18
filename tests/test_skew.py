"""One key holding a third of all rows: results stay exact and whole."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.operators import encode as ENC
from loam.operators import profile as P


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 49)}"
        rows.append((i, g, rnd.gauss(100, 15) if g != "hot" else rnd.choice([1.0, 2.0, 2.0, 3.0])))
    df = spark.createDataFrame(rows, "id long, grp string, x double").repartition(6)
    return df, pd.DataFrame(rows, columns=["id", "grp", "x"])


def test_grouped_medians_with_hot_group(spark, skewed):
    df, pdf = skewed
    got = {(r["grp"]): r for r in P.grouped_descriptive(df, ["x"], group_by=["grp"]).collect()}
    exp = pdf.groupby("grp")["x"].agg(["median", "count", "mean"])
    assert set(got) == set(exp.index)
    for g, row in exp.iterrows():
        assert got[g]["median"] == pytest.approx(row["median"], abs=1e-9)
        assert got[g]["count"] == row["count"]


def test_box_stats_hot_group(spark, skewed):
    df, pdf = skewed
    hot = P.box_stats(df, "grp", "x").where(F.col("grp") == "hot").first()
    s = pdf[pdf.grp == "hot"]["x"]
    assert (hot["q1"], hot["median"], hot["q3"]) == (s.quantile(0.25), s.quantile(0.5), s.quantile(0.75))
    assert hot["count"] == 1000


def test_hot_label_encoding_keeps_every_row(spark, skewed):
    df, pdf = skewed
    e = ENC.fit_label(df, "grp")
    out = ENC.apply_encoding(df, e)
    assert out.count() == 3000 and out.where(F.col("grp_encoded").isNull()).count() == 0
    codes = {r["grp"]: r["grp_encoded"] for r in out.select("grp", "grp_encoded").distinct().collect()}
    assert codes == {v: i for i, v in enumerate(sorted(pdf.grp.unique()))}


def test_top_values_hot_value(spark, skewed):
    df, _pdf = skewed
    top = P.top_values(df, ["grp"], k=1).first()
    assert top["value"] == "hot" and top["count"] == 1000
