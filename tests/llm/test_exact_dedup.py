"""Exact dedup against grouping by text, with colliding block hashes and odd rows."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loam.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    low = -(1 << 63)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda d: low if d is None else d)
        for d in ids:
            out.append((d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **params):
    got = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **params).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one of each group, also where ids repeat
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def rows_of(seed=0):
    rng = random.Random(seed)
    texts = ["", "a", "ab", "é" * 9, "abcdefgh", "abcdefgh" * 2, "abcdefghabcdefgX", "x" * 33, "x" * 32, "y" * 1000]
    texts += ["".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    return rows + [(400, None), (401, None), (None, "ab"), (None, None), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("size", [3, 8, 4096])
def test_blocks_of_any_size(spark, size):
    check(spark, rows_of(), block_bytes=size)


def test_blocks_that_share_a_hash(spark):
    check(spark, rows_of(1), block_bytes=5, hash_fn=lambda b: F.xxhash64(b) % 3)


def test_documents(spark):
    check(spark, duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())


def test_keep_one_and_empty_table(spark):
    df = spark.createDataFrame([(1, "t", 5), (2, "t", 6), (2, "t", 7), (None, None, 8), (3, "", 9)],
                               "doc_id long, text string, kept int")
    got = ed.keep_one(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "3"]
    assert ed.keep_one(df.limit(0)).count() == 0
