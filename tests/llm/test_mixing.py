"""Apportionment against handing out seats one by one; the mix against its twin and its promises."""

import collections
import heapq
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from loam.llm import mixing as X, mixing_sql
from loam.llm.common import saved
from loam.llm.ranks import apportion, running

SCHEMA = "doc_id long, source string, text string, size long, g string, words string"


def one_by_one(rows, seats):
    """rows: k -> (votes, cap)."""
    won = dict.fromkeys(rows, 0)
    heap = [(-votes, k) for k, (votes, cap) in rows.items() if cap > 0 and votes > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < rows[k][1]:
            heapq.heappush(heap, (-rows[k][0] / (2 * won[k] + 1), k))
    return won


@pytest.mark.parametrize("seed", range(3))
def test_apportion(spark, seed):
    rng = random.Random(seed)
    groups = []
    for g in range(12):
        n = rng.choice([1, 2, 3, 7, 40])
        rows = {k: (rng.choice([0, 1, 1, 2, 5, rng.random(), 1000, 1e6]) * 1.0, rng.choice([0, 1, 3, 50, 10 ** 6])) for k in range(n)}
        groups.append((rows, rng.choice([0, 1, 2, 10, 333, 5000])))
    data = [(g, k, v, c, s, float(sum(x for x, _ in rows.values())), len(rows))
            for g, (rows, s) in enumerate(groups) for k, (v, c) in rows.items()]
    df = spark.createDataFrame(data, "g long, k long, votes double, cap long, seats long, total double, many long")
    got = {(r.g, r.k): r.won for r in apportion(saved(df, "t"), "t").collect()}
    for g, (rows, s) in enumerate(groups):
        assert {k: got[g, k] for k in rows} == one_by_one(rows, s), (g, rows, s)


def test_running(spark):
    df = saved(spark.range(5000).select((F.col("id") % 97).alias("k"), F.col("id").alias("v")), "r")
    rows = running(df, [F.desc("k"), "v"], "r2", "v").collect()
    want, total = {}, 0
    for i, v in enumerate(sorted(range(5000), key=lambda v: (-(v % 97), v))):
        want[v], total = (i, total), total + v
    assert {r.v: (r.place, r.before) for r in rows} == want


def documents(seed=0, n=800):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice(["a"] * 9 + ["b", "c", "d", None, "é"])
        out.append((i, s, " ".join(["w"] * rng.randint(0, 120)) if i % 50 else None))
    out += [(n, "a", "x " * 20_000), (n + 1, "tiny", "one two three"), (n + 2, "empty", ""), (n + 2, "empty", None), (5, "a", "w w w"), (5, "a", "w w w")]
    return out


def twin(rows, **params):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    return sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({mixing_sql.sql(**params)})").fetchall(), key=str)


def mixed(spark, rows, parts=3, **params):
    df = spark.createDataFrame([(d, s, t, 1, "g", "w") for d, s, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in X.mix(df, **params).collect()), key=str)


@pytest.mark.parametrize("block,shard", [(64, 1024), (7, 10)])
def test_against_twin(spark, block, shard):
    rows = documents()
    assert mixed(spark, rows, block_words=block, shard_blocks=shard) == twin(rows, block=block, shard=shard)


def test_promises(spark):
    rows = documents(1)[:-2]  # each doc_id in one source
    got = mixed(spark, rows, block_words=16)
    assert got == mixed(spark, rows, parts=7, block_words=16)  # reruns agree
    of, taken, target = {d: s for d, s, _ in rows}, collections.Counter(), {}
    for d, size, source_size, t, n in got:
        assert 0 <= n <= 3 * size
        taken[of[d]] += n
        target[of[d]] = (t, source_size)
    words = sum(r[1] for r in got)
    assert abs(sum(t for t, _ in target.values()) - words) < 1e-6 * words
    for s, (t, size) in target.items():
        assert t <= 3 * size and abs(taken[s] - t) <= 4 * 16
    # those below their cap are in proportion to their weights
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(x for x in target if x is not None) + [None])}
    free = {Fraction(t).limit_denominator(10 ** 6) / weights[s] for s, (t, size) in target.items() if t < 3 * size}
    assert max(free) - min(free) < Fraction(1, 10 ** 3)


def test_targets_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 20, "c": 5000, "d": 400, "e": 1, "f": 0, "g": 3000}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in X.targets(df).collect()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: 3 * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in sizes if x not in full) for s in sizes}
        above = {s for s in sizes if share[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(share)


def test_odd_tables(spark):
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, None), (None, "a", "")]) == [(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)]
    assert mixed(spark, [(1, "a", "w " * 640)]) == [(1, 640, 640, 640.0, 640)]
