"""Line field: messages against enumeration, gradient against differences, held-out accuracy."""

from itertools import product

import numpy as np

from loam.llm import line_quality as q
from loam.llm.common import held_out


def path_score(e, moves, y):
    return sum(e[t] * y[t] for t in range(len(y))) + sum(moves[a, b] for a, b in zip(y, y[1:]))


def test_marginals_and_pairs_against_enumeration():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(2, 2))
    lengths = np.array([5, 3, 1])
    e = rng.normal(size=(3, 5))
    got = q.marginals(e, lengths, moves)
    pairs = q._pair_marginals(e, *q._messages(e, lengths, moves), moves)
    for d, n in enumerate(lengths):
        paths = list(product((0, 1), repeat=int(n)))
        w = np.exp([path_score(e[d, :n], moves, y) for y in paths])
        w /= w.sum()
        for t in range(n):
            assert np.isclose(got[d, t], sum(p for p, y in zip(w, paths) if y[t] == 1))
            for a, b in product((0, 1), repeat=2):
                if t:
                    want = sum(p for p, y in zip(w, paths) if (y[t - 1], y[t]) == (a, b))
                    assert np.isclose(pairs[a][b][d, t], want)


def test_training_separates():
    good = "The ship sailed on.\nIt was a long way, and quiet."
    bad = "BUY!! NOW!! BUY!!\nspam spam spam spam spam"
    feats = [q.with_neighbours(q.line_features(t)[0]) for t in (good, bad) * 10]
    model = q.train(feats, np.array([1, 0] * 10))
    a, b = q.score_texts(model, [good, bad])
    assert a > 0.8 and b < 0.2
    mixed = q.score_texts(model, [good + "\n" + bad])[0]
    assert b < mixed < a


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = q.fit(docs, labels.where(~held_out("doc_id", 4)), sample_docs=300)
    got = docs.join(labels, "doc_id").where(held_out("doc_id", 4)).select("quality", q.score(model, docs["text"]).alias("s"))
    rows = got.collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.s >= q.THRESHOLD for r in rows])
    assert (y == p).mean() > 0.97 and p[y == 1].mean() > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "A fine line of prose, it is."), (2, "xx xx xx xx xx\nxx xx xx xx"), (2, "xx xx xx xx"),
                                  (3, None), (4, ""), (None, "\n\n"), (5, "word " * 50000), (6, "a\n" * 3000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (2, 0, "y"), (9, 1, "z"), (None, 0, "w"), (3, None, "v")],
                                   "doc_id long, quality int, text string")
    model = q.fit(docs, labels)
    from pyspark.sql import functions as F
    rows = docs.select("doc_id", q.score(model, F.col("text")).alias("s")).collect()
    assert len(rows) == 8 and all(0 <= r.s <= 1 for r in rows)
    one = q.fit(docs, labels.where("quality = 1"))
    none = q.fit(docs, labels.limit(0))
    assert one.constant == 1.0 and none.constant == 1.0
    assert q.fit(docs.limit(0), labels).constant == 1.0
    assert docs.limit(0).select(q.score(model, F.col("text"))).count() == 0
