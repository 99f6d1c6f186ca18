"""SimHash near-dedup against brute force."""

import random

import duckdb
import numpy as np
import xxhash

from loam.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=4):
    """fps: {doc_id: fingerprint} -> {doc_id: smallest linked doc_id}."""
    parent = {d: d for d in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(fps)
    values = np.array([fps[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits):
            a, b = sorted((top(d), top(ids[j])))
            parent[b] = a
    return {d: top(d) for d in ids}


def check(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {d: brute_fingerprint(t) for d, t in rows}
    comp = brute_components(want)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == \
        {(d, f"{want[d]:016x}", comp[d]) for d in want}
    assert len(got) == len(rows)


def test_documents_against_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    check(spark, rows)


def test_edge_texts(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice("abcdefgh") * 3 + str(i) for i in range(300))
    near = base.replace("7 ", "8 ", 1)
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "É é"), (7, base), (8, near),
                  (9, "word " * 5000), (10, base)])


def test_links_connect_every_close_pair(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(30):  # dense clusters: chains, balls and far points
        c = rng.getrandbits(64)
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63}
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    for bits in (4, 3):
        pairs = [(r.a, r.b) for r in simhash.links(fps, bits).collect()]
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= bits for a, b in pairs)
        want = brute_components({v: v for v in values}, bits)
        parent = {v: v for v in signed.values()}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in pairs:
            parent[top(a)] = top(b)
        got = {}
        for v, s in signed.items():
            got.setdefault(top(s), set()).add(v)
        groups = {}
        for v, c in want.items():
            groups.setdefault(c, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_thresholds_always_sum_to_the_bound():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    bits = simhash._bits(fps)
    x = bits.astype(float)
    groups = simhash.group_bits(x.T @ x, 500, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    pieces = simhash._octets(groups)
    hist = np.stack([np.bincount(simhash._piece_values(bits, p), minlength=256) for _, p in pieces])
    deal = simhash.Deal(groups, simhash._distance_tables(hist, 500, 4), 500, 4)
    assert (deal.thresholds(bits).sum(axis=1) == 5).all()


def test_keep_one_and_empty_table(spark):
    schema = "doc_id long, text string, component_id string, fp long"
    rows = [(3, "a b c d e", "x", 1), (1, "a b c d e", "y", 2), (None, "a b c d e", "z", 3), (1, "a b c d e", "q", 4),
            (7, "other words are here now", "x", 5)]
    kept = simhash.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "component_id", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7]
    empty = spark.createDataFrame([], schema)
    assert simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
