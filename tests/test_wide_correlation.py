"""Correlations of very wide tables: bounded memory and the same values tile by tile."""

import numpy as np
import pytest

from loam.operators import profile as P


def wide(spark, n, k, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) + 1000
    x[rng.random((n, k)) < 0.1] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return x, spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(k)))


def expected(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    return np.corrcoef(x[both, i], x[both, j])[0, 1]


@pytest.mark.parametrize("size", [256 << 20, 48 * 12 * 5])
def test_tiles(spark, size, monkeypatch):
    monkeypatch.setattr(P, "CORRELATION_BYTES", size)
    monkeypatch.setattr(P, "SLICE_NUMBERS", 100)
    x, df = wide(spark, 60, 12)
    got = {(r.column_a, r.column_b): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert len(got) == 144
    for i in range(12):
        for j in range(12):
            assert got[f"c{i}", f"c{j}"] == pytest.approx(expected(x, i, j), abs=1e-9)


def test_a_worker_holds_little():
    """2,000 columns: the sums of one worker and its slices stay far below a gigabyte."""
    import subprocess
    import sys
    code = """
import numpy as np, pyarrow as pa, resource
from loam.operators import profile as P
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
k = 2000
batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000.0) + i) for i in range(k)], [f"c{i}" for i in range(k)])
rows = sum(b.num_rows for b in P._pair_sums([0.0] * k, 0, k)([batch]))
assert rows == k * (k + 1) // 2
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert int(out.split()[-1]) < 800
