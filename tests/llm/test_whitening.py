"""Whitening against a dense eigen-decomposition and exact integer arithmetic."""

import math
import random

import duckdb
import numpy as np
import pytest

from loam.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def brute(rows, k=8):
    """What is expected of (key, vector) rows: n, per-row deviations, eigenpairs, x."""
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(dim)]
    dev = [sum((n * x[j] - sums[j]) ** 2 for j in range(dim)) for _, x in good]
    c = np.array([[(n * x[j] - sums[j]) / n for j in range(dim)] for _, x in good])
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, [i for i, _ in good], dev, e[::-1][:k], u[:, ::-1][:, :k], c, np.trace(c.T @ c / n)


def check(got, rows, k=8, tol=1e-9):
    n, ids, dev, e, u, c, trace = brute(rows, k)
    k = min(k, len(e))
    assert len(got) == n * k
    by = {}
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / trace) < 1e-9
        assert r.identity_error < 1e-9
        by[r.vec_id, r.component] = r
    for j in range(k):
        white = c @ u[:, j] / np.sqrt(e[j])
        mine = np.array([by[i, j + 1].whitened for i in ids])
        assert min(abs(mine - white).max(), abs(mine + white).max()) < tol  # either sign, the same for all
    assert [by[i, 1].deviation for i in ids] == dev


def test_against_dense(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j % 5) + (3 if j == 2 else 0) for j in range(12)]) for i in range(400)]
    rows += [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, []),
             (505, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(5)
    check(W.whiten(df).collect(), [r for r in rows if r[0] != 505])


def test_documents_table(spark):
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    got = W.whiten(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    check(got, rows)


def test_residuals_at_rounding(spark):
    model = W.fit(W.packed(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")))
    assert model.residual <= 64 * W.EPS * model.values[0]
    assert model.products < 80
    assert np.abs(model.vectors.T @ model.vectors - np.eye(8)).max() < 1e-13


@pytest.mark.parametrize("dim", [1, 3, 9, 40])
def test_small_dimensions(dim):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((dim, dim))
    a = a @ a.T
    values, vectors, residual = W.eigenpairs(lambda m: a @ m, dim, 8)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], rtol=1e-12, atol=1e-12)


def test_repeated_eigenvalues():
    a = np.diag([5.0, 5, 5, 5, 2, 2, 2, 2, 2, 2, 1, 1, 0, 0, 0])
    values, vectors, _ = W.eigenpairs(lambda m: a @ m, 15, 8)
    assert np.allclose(values, [5, 5, 5, 5, 2, 2, 2, 2]) and np.allclose(a @ vectors, vectors * values)


def test_close_eigenvalues_of_a_large_matrix():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    e = 1000 + np.arange(300) * 0.5
    a = (q * e) @ q.T
    values, vectors, residual = W.eigenpairs(lambda m: a @ m, 300, 8)
    assert np.allclose(values, e[::-1][:8], rtol=1e-12) and residual < 1e-9


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty).count() == 0 and W.whiten(empty).columns[0] == "vec_id"
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "") for i in range(5)], SCHEMA)
    assert W.whiten(same).count() == 0  # nothing varies
    line = spark.createDataFrame([(1, [1.0, 5.0, 0.0], 1, ""), (1, [1.0, 5.0, 0.0], 1, ""), (None, [2.0, 7.0, 0.0], 1, "")], SCHEMA)
    got = W.whiten(line).collect()  # rank one: one component; repeated rows and a NULL key stay
    assert sorted((str(r.vec_id), r.component) for r in got) == [("1", 1), ("1", 1), ("None", 1)]
    assert sum(r.whitened ** 2 for r in got) / 3 == pytest.approx(1)


def test_deviation_beyond_a_long(spark):
    x = np.array([[0], [2 ** 40]], np.int64)
    assert W._deviations(x, 2 ** 20, np.array([2 ** 59])) == [None, None]
    assert W._deviations(np.array([[3], [5]], np.int64), 2, np.array([8])) == [4, 4]
