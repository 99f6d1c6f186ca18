"""Sequential IQR trimming in three scans against trimming column by column."""

import numpy as np
import pytest

from loam.operators import outliers as OUT


def one_by_one(x):
    rows = np.arange(len(x))
    for j in range(x.shape[1]):
        v = x[rows, j]
        known = v[~np.isnan(v)]
        if not len(known):
            continue
        q1, q3 = np.quantile(known, [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        rows = rows[~((v < lo) | (v > hi))]
    return set(rows.tolist())


def kinds(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    yield "normal", np.stack([a, a + rng.normal(size=n), rng.exponential(size=n)], 1)
    yield "discrete", np.stack([rng.integers(0, 11, n), rng.poisson(3, n), rng.normal(size=n).round(1)], 1).astype(float)
    gaps = rng.normal(size=(n, 3))
    gaps[rng.random((n, 3)) < 0.2] = np.nan
    gaps[:, 2] = np.nan
    yield "gaps", gaps
    yield "constant", np.stack([np.full(n, 4.0), rng.normal(size=n)], 1)
    yield "heavy", np.stack([rng.standard_cauchy(n), np.concatenate([np.zeros(n // 2), rng.normal(size=n - n // 2)])], 1)


@pytest.mark.parametrize("spread", [False, True])
def test_same_rows(spark, spread, monkeypatch):
    if spread:
        monkeypatch.setattr(OUT, "_COLLECTED", 0)
    used = {}
    for name, x in kinds(20_000 if not spread else 5000, 3):
        cols = [f"c{j}" for j in range(x.shape[1])]
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
        used[name] = OUT.sequential_fences(df, cols) is not None
        got = {r.id for r in OUT.remove_outliers(df, "iqr", columns=cols).select("id").collect()}
        assert got == one_by_one(x), name
    assert used["normal"] and used["gaps"]


def test_small_and_empty(spark):
    for n in (0, 1, 3, 12):
        x = np.arange(2 * n, dtype=float).reshape(n, 2)
        if n == 12:
            x[11] = [500, 1]
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
        assert {r.id for r in OUT.remove_outliers(df, "iqr", columns=["a", "b"]).collect()} == one_by_one(x.reshape(-1, 2))
