"""Whitening of embeddings along their leading principal components.

The covariance matrix is never formed.  What touches the rows is a matrix-free product:
each task centres its vectors and returns its share of ``C' C M`` for a block of columns
``M``.  Everything else works on a basis of a few dozen vectors of the embeddings'
dimension, which does not grow with the rows:

* Jacobi-Davidson: the basis grows by approximate solutions of the correction equations
  ``(I - P)(A - theta I)(I - P) t = -r``, one for each wanted pair that has not converged;
  P projects on the locked vectors and the current Ritz vectors.  They are solved by a
  few steps of MINRES, all equations side by side, so that a step costs one product.
* Rayleigh-Ritz over the basis; a pair whose residual has come down to rounding is
  locked, and the rest is kept orthogonal to it.  A basis that has grown too large is
  restarted with its leading Ritz vectors.

Scale: vectors are packed once into blocks of at most 4 MB and written; a product reads
these blocks and shuffles nothing.  Partial results (dimension x columns) are added up in
a fixed order, by a second level of tasks when there are many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import saved

#: An entry c becomes floor(1024 c) + 100000.
SCALE, SHIFT = 1024, 100_000
#: Entries that this many or more in absolute value after scaling cannot be told apart as doubles.
LARGEST = 2.0 ** 52
BLOCK_BYTES = 4 << 20
#: Partial results that the driver adds up by itself.
FAN_IN = 256
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """Fitted statistics: everything here has the size of a few vectors."""
    n: int
    sums: np.ndarray          # of x, per dimension (int64)
    vectors: np.ndarray       # dimension x components, unit columns
    values: np.ndarray        # eigenvalues, falling
    trace: float
    residual: float           # largest |A v - e v| of a component
    identity_error: float
    products: int             # passes over the rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, vector) rows as blocks of integers; rows of one length share a block."""
    for batch in batches:
        keys, vectors = batch.column(0), batch.column(1)
        whole = vectors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.where(whole, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0))
        entries = vectors.flatten()
        values = entries.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        scaled = np.floor(values * SCALE)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < LARGEST))])  # NaN is bad too
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sizes = ends - starts
        usable = np.flatnonzero(whole & (sizes > 0) & (bad[ends] == bad[starts]))
        for dim in np.unique(sizes[usable]):
            rows = usable[sizes[usable] == dim]
            step = max(1, BLOCK_BYTES // (8 * int(dim)))
            for at in range(0, len(rows), step):
                some = rows[at: at + step]
                x = scaled[starts[some][:, None] + np.arange(dim)].astype(np.int64) + SHIFT
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dim)], pa.int32()), pa.array([len(some)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), keys.take(pa.array(some))),
                     pa.array([x.tobytes()], pa.binary())], ["dim", "n", "keys", "x"])


def packed(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Usable vectors as written blocks: dim, n, keys, x (int64, row after row).

    Vectors of the commonest length are usable (of several such lengths the largest).
    """
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("x", T.BinaryType())])
    blocks = saved(df.select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(_blocks, schema), "vectors")
    dims = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return blocks.where(F.col("dim") == (dims[0]["dim"] if dims else 0))


def _matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for dim, x in zip(batch.column("dim").to_pylist(), batch.column("x")):
        yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim)


def summed(blocks: DataFrame, share: Callable[[np.ndarray], np.ndarray], two_levels: bool = True) -> tuple[np.ndarray | None, int]:
    """Sum of ``share`` over all blocks (None without blocks) and how many tasks had some.

    ``share`` maps the integers of a block to an array of fixed shape.  Shares are added
    in the order of partitions, so that a rerun over the same files gives the same bits.
    """
    def of_task(batches):
        total = None
        for batch in batches:
            for x in _matrices(batch):
                total = share(x) if total is None else total + share(x)
        if total is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([1], pa.int64()),
                                              pa.array([total.dtype.str]), pa.array([total.tobytes()], pa.binary())],
                                             ["at", "tasks", "kind", "data"])

    def of_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        total = sum(np.frombuffer(d.as_buffer(), k) for d, k in zip(table["data"], table["kind"].to_pylist()))
        return pa.table({"at": table["at"].slice(0, 1), "tasks": [table.num_rows], "kind": table["kind"].slice(0, 1),
                         "data": pa.array([total.tobytes()], pa.binary())})

    schema = "at long, tasks long, kind string, data binary"
    parts = blocks.select("dim", "x").mapInArrow(of_task, schema)
    if two_levels:
        parts = parts.groupBy((F.col("at") % FAN_IN).alias("g")).applyInArrow(of_group, schema)
    rows = sorted(parts.collect(), key=lambda r: r["at"])
    if not rows:
        return None, 0
    return sum(np.frombuffer(r["data"], r["kind"]) for r in rows), sum(r["tasks"] for r in rows)


def _minres(product, rhs: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, side by side."""
    x, old, w0, w1 = (np.zeros_like(rhs) for _ in range(4))
    beta = np.linalg.norm(rhs, axis=0)
    first, eta = beta, beta.copy()
    v = rhs / np.where(beta > 0, beta, 1)
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * old
        after = np.linalg.norm(p, axis=0)
        rho0, rho2, rho3 = c1 * alpha - c0 * s1 * beta, s1 * alpha + c0 * c1 * beta, s0 * beta
        rho1 = np.hypot(rho0, after)
        rho1 = np.where(rho1 > 0, rho1, 1)
        w = (v - rho3 * w0 - rho2 * w1) / rho1
        c0, c1, s0, s1 = c1, rho0 / rho1, s1, after / rho1
        x = x + c1 * eta * w
        eta, w0, w1 = -s1 * eta, w1, w
        old, v, beta = v, p / np.where(after > 0, after, 1), after
        if (np.abs(eta) <= goal * first).all():
            break
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``new`` beside ``against``; what hardly differs from it goes."""
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 1e-12] / norms[norms > 1e-12]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8 * s[0]]
    return new


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, inner: int = 6, seed: int = 11,
               rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues (falling), their unit vectors and the largest residual norm.

    ``product`` applies the symmetric matrix to a block of columns.  A pair is locked when
    its residual is at the rounding error of a product, or no longer falls and is below
    1e-11 of the matrix.
    """
    wanted = min(wanted, dim)
    block = min(dim, 2 * wanted)  # wanted pairs, and as many that guard them
    most = 4 * block
    q = np.zeros((dim, 0))
    v = _orthonormal(np.random.default_rng(seed).standard_normal((dim, block)))
    av = product(v)
    past: list[float] = []
    for turn in range(rounds):
        values, u = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        values, u = values[::-1], u[:, ::-1]
        v, av = v @ u, av @ u
        size = max(values[0] if not q.shape[1] else scale, 0.0)  # noqa: F821 (set below on the first turn)
        scale = size
        need = wanted - q.shape[1]
        errors = np.linalg.norm(av[:, :need] - v[:, :need] * values[:need], axis=0)
        full = q.shape[1] + v.shape[1] >= dim
        past.append(float(errors.max()))
        stuck = len(past) > 3 and past[-1] <= 1e-11 * size and past[-1] > 0.5 * min(past[-4:-1])
        done = (errors <= 4 * EPS * size) | full | stuck
        if done.any():
            past = []
            kept = np.concatenate([np.flatnonzero(~done), np.arange(need, v.shape[1])]).astype(int)
            q = np.concatenate([q, v[:, np.flatnonzero(done)]], axis=1)
            v, av, values = v[:, kept], av[:, kept], values[kept]
            need = wanted - q.shape[1]
        if need <= 0:
            break
        if v.shape[1] > most:
            v, av, values = v[:, :block], av[:, :block], values[:block]
        ritz, theta = v[:, :min(block, v.shape[1])], values[:need]
        residual = av[:, :need] - v[:, :need] * theta
        beside = lambda z: z - q @ (q.T @ z) - ritz @ (ritz.T @ z)  # noqa: B023,E731
        residual = beside(residual)
        new = _minres(lambda z: beside(product(z)) - z * theta, -residual, inner, 0.5 ** (turn + 2))  # noqa: B023
        new = _orthonormal(np.concatenate([new, residual], axis=1) if not new.any() else new, q, v)
        if not new.shape[1]:  # nothing to add but rounding errors: try a direction that is not spanned yet
            new = _orthonormal(np.random.default_rng(seed + turn + 1).standard_normal((dim, need)), q, v)
        v, av = np.concatenate([v, new], axis=1), np.concatenate([av, product(new)], axis=1)
    else:
        raise RuntimeError("the eigenpairs did not converge")
    q = _orthonormal(q)
    aq = product(q)
    values, u = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
    values, u = values[::-1], u[:, ::-1]
    q, aq = q @ u, aq @ u
    return values, q / np.linalg.norm(q, axis=0), float(np.linalg.norm(aq - q * values, axis=0).max())


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as doubles, rounded once where n x fits 64 bits."""
    if n < 2 ** 62 // max(1, int(np.abs(x).max(initial=0)), int(np.abs(sums // max(n, 1)).max(initial=0)) + 1):
        return (n * x - sums) / n
    return x - sums / n


def fit(blocks: DataFrame, components: int = 8, inner: int = 6) -> Whitening | None:
    """Leading components of all packed vectors; None where nothing varies or no vector is left.

    Components whose eigenvalue is only rounding (below 1e-12 of the trace) are left out.
    """
    got = blocks.agg(F.sum("n").alias("n"), F.max("dim").alias("dim")).first()
    if not got["n"]:
        return None
    n, dim = got["n"], got["dim"]
    moments, tasks = summed(blocks, lambda x: np.stack([x.sum(0), ((x - SHIFT) ** 2).sum(0)]))
    sums, squares = moments.reshape(2, dim)
    # exact: shifting a dimension does not change its variance
    spread = sum(n * int(q) - (int(s) - n * SHIFT) ** 2 for s, q in zip(sums, squares))
    if spread == 0:
        return None
    trace, passes, two = spread / n ** 2, [0], tasks > FAN_IN

    def product(m: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def share(x):
            c = _centred(x, n, sums)
            return c.T @ (c @ m)
        return summed(blocks, share, two)[0].reshape(m.shape) / n

    values, vectors, residual = eigenpairs(product, dim, components, inner)
    real = values > 1e-12 * trace
    values, vectors = values[real], vectors[:, real]

    def second(x):
        w = _centred(x, n, sums) @ vectors / np.sqrt(values)
        w1 = np.concatenate([w, np.ones((len(w), 1))], axis=1)
        return w1.T @ w1
    k = len(values)
    m2 = summed(blocks, second, two)[0].reshape(k + 1, k + 1) / n
    error = np.abs(m2[:k, :k] - np.outer(m2[k, :k], m2[k, :k]) - np.eye(k)).max()
    return Whitening(n, sums, vectors, values, trace, residual, float(error), passes[0])


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; None where one does not fit a long."""
    top = n * (int(np.abs(x).max()) + 1) + int(np.abs(sums).max())
    if top < 2 ** 62 and top ** 2 * x.shape[1] < 2 ** 63:
        return ((n * x - sums) ** 2).sum(1).tolist()
    near = n * int(np.abs(x - sums // n).max() + 2)  # n x - S itself is far smaller than n x
    if top < 2 ** 62 and near ** 2 * x.shape[1] < 2 ** 63:
        return ((n * x - sums) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [d if d < 2 ** 63 else None for d in exact]


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Left out: NULL and empty vectors, those with a NULL, NaN or infinite entry (or one whose
    scaled value exceeds 2^52), and those whose length is not the commonest one.  A NULL key
    stays NULL, rows with equal keys each give their own rows.  Fewer than ``components``
    rows come for a vector where the rest of the variance is zero; none for an empty table
    or where all vectors are equal.  ``deviation`` is NULL where it exceeds a long.  Other
    columns are ignored.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    blocks = packed(df, vector, key)
    model = fit(blocks, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, vectors, values, k = model.n, model.sums, model.vectors, model.values, len(model.values)
    explained, error = values / model.trace, model.identity_error

    def rows(batches):
        for batch in batches:
            for keys, x in zip(batch.column("keys"), _matrices(batch)):
                white = _centred(x, n, sums) @ vectors / np.sqrt(values)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [keys.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(each),
                     pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    schema.names)
    return blocks.select("keys", "dim", "x").mapInArrow(rows, schema)
