"""Quantiles by sketch and count against numpy, and their way out."""

import numpy as np
import pytest

from loam.operators import quantiles as Q


def columns(n, seed=0):
    rng = np.random.default_rng(seed)
    return {"normal": rng.normal(size=n), "few": rng.integers(0, 7, n).astype(float), "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n)),
            "wide": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n), "skew": rng.exponential(size=n) ** 8,
            "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), "constant": np.full(n, 3.0)}


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_against_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BRACKET_VALUES", limit)
    monkeypatch.setattr(Q, "DIRECT_MAX", 1000)
    data = columns(30_000)
    used = []
    real = Q.bracketed_ranks
    monkeypatch.setattr(Q, "bracketed_ranks", lambda *a: used.append(real(*a)) or used[-1])
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {(r["column_name"], r["prob"]): r["value"] for r in Q.exact_quantiles(df, list(data), probs, direct_max=1000).collect()}
    assert (used[0] is not None) == (limit > 0)
    for c, v in data.items():
        v = v[~np.isnan(v)]
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(v, p), rel=1e-12), (c, p)


def test_many_columns_are_narrowed(spark):
    df = spark.range(3000).selectExpr(*[f"cast(id * {i + 1} as double) as c{i}" for i in range(Q.BRACKET_COLUMNS + 1)])
    got = {r["column_name"]: r["value"] for r in Q.exact_quantiles(df, df.columns, [0.5], direct_max=10).collect()}
    assert got == {f"c{i}": 1499.5 * (i + 1) for i in range(Q.BRACKET_COLUMNS + 1)}
