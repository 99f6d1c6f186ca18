"""Repeated-string removal against brute force; the merge sort by itself."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from loam.llm import suffix_dedup as sd


def brute(rows, length):
    """(key, n_bytes, n_removed, n_spans, kept_sha256) by counting every string."""
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for k, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **params):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in sd.digests(sd.remove_repeats(df, **params)).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_merge_gives_order_and_prefixes(seed):
    rng = random.Random(seed)
    runs = []
    for _ in range(rng.randint(1, 9)):
        words = {bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(rng.randint(0, 60))}
        ordered = sorted(words)
        coded = sd.front_code(ordered, sd.prefixes(ordered))
        back, shared = sd.front_decode(*coded)
        assert back == ordered and shared == sd.prefixes(ordered)
        runs.append((back, shared))
    got = list(sd.merge(runs))
    strings = [runs[r][0][i] for r, i, _ in got]
    assert strings == sorted(s for r in runs for s in r[0])
    assert [p for *_, p in got] == sd.prefixes(strings)


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(1)
    text = bytes(rng.choices(b"abcd ", k=3000))
    place, first, last = sd.anchors(text, 60, 24)
    own = {}
    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist()):
        for s in range(a, b + 1):
            own[s] = p - s
    assert sorted(own) == list(range(len(text) - 59)) and all(0 <= o < 24 for o in own.values())
    for s in rng.sample(range(len(text) - 59), 50):
        alone = sd.anchors(text[s:s + 60], 60, 24)
        assert alone[0].tolist() == [own[s]]


def test_chunks_do_not_change_anchors(monkeypatch):
    text = bytes(random.Random(2).choices(b"ab", k=5000))
    whole = [x.tolist() for x in sd.anchors(text, 50, 20)]
    monkeypatch.setattr(sd, "CHUNK", 137)
    assert [x.tolist() for x in sd.anchors(text, 50, 20)] == whole


def synthetic(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    passages = ["".join(rng.choices(letters, k=rng.randint(20, 200))) for _ in range(8)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(passages)[rng.randint(0, 15):rng.randint(20, 200)] + "".join(rng.choices(letters, k=rng.randint(0, 60)))
                    for _ in range(rng.randint(0, 4)))
        rows.append((i, t))
    rows += [(100, "ab" * 400), (101, "a" * 500), (102, None), (103, ""), (None, rows[3][1]), (3, rows[3][1]), (104, passages[0] * 3)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_synthetic_against_brute_force(spark, seed):
    rows = synthetic(seed)
    assert run(spark, rows, length=40, spread=16, run_size=70, range_size=90) == brute(rows, 40)


def test_documents_against_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(9001, rows[0][1][:150] + rows[5][1]), (9002, "x" * 250)]
    want = brute(rows, 200)
    assert any(r[2] for r in want)
    assert run(spark, rows) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans int, row int")
    assert sd.digests(sd.remove_repeats(df)).count() == 0
