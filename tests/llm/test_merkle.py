"""Manifest against a tree built node by node, layout arithmetic against a recursive layout, and odd tables."""

import hashlib
import zlib

import duckdb
import pytest

from loam.llm import manifest_sql, merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, n long, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row[0], row[1], row[2], row[3], row[4] if text is None else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 16
        out.append((i % 16, level[a:i] + level[i + 1:a + 16]))
        i //= 16
    return out


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = beside(trees[s], i) + beside(top, g)
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf(r, lower(r[4]))
            for at, others in steps:
                now = h(*others[:at], now, *others[at:])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*[x for _, o in steps for x in o]), now, now == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in M.manifest(df).collect()), key=str)
    want = brute(rows)
    assert got == want
    return want


def rows_of(n, sources=("a", "b", None, "é", "Z")):
    return [(i, sources[i % len(sources)], "en" if i % 3 else None, i if i % 7 else None, f"Text {i} É" if i % 4 else ("" if i % 8 else None))
            for i in range(n)]


@pytest.mark.parametrize("n", [1, 17, 85, 400])
def test_sizes(spark, n):
    check(spark, rows_of(n))


def test_hot_source_over_several_blocks(spark, monkeypatch):
    # blocks of 16 and of 256 leaves make the same trees as blocks of 4096, in more tiers
    rows = rows_of(100) + [(i, "hot", "en", 3, f"Hot {i}") for i in range(1000, 1700)]
    want = check(spark, rows)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("edges", [1, 2])
def test_more_tiers(spark, edges):
    """Tiers of any number of levels: built in this process, tier by tier."""
    leaves = [h(str(i)) for i in range(700)]
    level, width, spans = leaves, 16 ** edges, []
    while True:
        n, tier = len(level), []
        for at in range(0, n, width):
            part = level[at:at + width]
            e = min(edges, M.height(n))
            store, root = M.build(part, e)
            tier.append((store, e, len(part), root))
        spans.append(tier)
        level = [t[3] for t in tier]
        if n <= width:
            break
    want = tree(leaves)
    assert level == want[-1]
    for i in (0, 15, 16, 255, 256, 699):
        steps, at = [], i
        for tier in spans:
            store, e, used, _ = tier[at // width]
            steps += list(M.siblings(store, e, used, at % width))
            at //= width
        assert steps == beside(want, i) and M.fold(leaves[i], steps) == level[0] and M._steps(M._bytes(steps)) == steps


@pytest.mark.parametrize("edges", [0, 1, 2, 3])
def test_layout(edges):
    """Every node has a place of its own; the upper half is one stretch and so is each lower subtree."""
    def lay(top_level, index, levels):  # nodes (depth, index) of a subtree in order
        if levels == 1:
            return [(top_level, index)]
        upper = levels // 2
        out = lay(top_level, index, upper)
        for j in range(16 ** upper):
            out += lay(top_level + upper, index * 16 ** upper + j, levels - upper)
        return out
    order = lay(0, 0, edges + 1)
    assert len(order) == M.size(edges)
    for place, (depth, index) in enumerate(order):
        assert M.address(edges, edges - depth, index) == place


def test_repeats_nulls_and_long_texts(spark):
    rows = [(1, "a", "en", 1, "Same"), (1, "a", "en", 1, "Same"), (1, "a", "en", 1, "Other"), (None, "a", None, None, None),
            (None, None, None, None, "X"), (2, None, "de", 2, "W" * 300_000), (2, "", "de", 2, "")]
    check(spark, rows)


def test_empty(spark):
    got = M.manifest(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0


def test_tampering_shows(spark):
    want = check(spark, rows_of(60))
    assert {r[-1] for r in want} == {True, False}


def test_sql_twin():
    rows = rows_of(700) + [(3, "a", "en", 1, "again"), (None, "a", None, None, "No Id")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    cur = con.execute(manifest_sql.sql())
    names = [d[0] for d in cur.description]
    got = [dict(zip(names, r)) for r in cur.fetchall()]
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == brute(rows)
