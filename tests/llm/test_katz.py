"""Katz back-off against a brute-force version; distributions sum to one."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from loam.llm import katz


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w] + ["\n"]


class Brute:
    """The model by dictionaries over tuples of words."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [None] + [Counter() for _ in range(order)]
        for t in texts:
            seq = [" "] * (order - 1) + tokens_of(t)
            for i in range(order - 1, len(seq)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(seq[i - n + 1:i + 1])] += 1
        self.N, self.V = sum(self.counts[1].values()), len(self.counts[1])
        self.p, self.a = [None] + [{} for _ in range(order)], [None] + [{} for _ in range(order)]
        kept = self.kept(1)
        mass = sum(kept.values()) / max(self.N, 1)
        scale = 1 if 1 - mass >= 1 / (self.N + 1) else (1 - 1 / (self.N + 1)) / mass
        self.p[1] = {g: scale * k / self.N for g, k in kept.items()}
        self.unknown = 1 - scale * mass if self.N else 1
        for n in range(2, order + 1):
            kept = {g: k for g, k in self.kept(n).items() if self.counts[n][g] >= 2}
            followed = Counter()
            for g, c in self.counts[n].items():
                followed[g[:-1]] += c
            for h in {g[:-1] for g in kept}:
                own = [g for g in kept if g[:-1] == h]
                left = sum(kept[g] for g in own)
                of = followed[h] + (left >= followed[h] * (1 - 1e-12))
                self.a[n][h] = (1 - left / of) / (1 - sum(self.p[n - 1][g[1:]] for g in own))
                for g in own:
                    self.p[n][g] = kept[g] / of

    def kept(self, n):
        d = katz.discounts(Counter(self.counts[n].values()))
        return {g: d.get(c, 1) * c for g, c in self.counts[n].items()}

    def prob(self, gram):
        n = len(gram)
        if gram in self.p[n]:
            return self.p[n][gram]
        return self.unknown if n == 1 else self.a[n].get(gram[:-1], 1) * self.prob(gram[1:])

    def score(self, text):
        seq = [" "] * (self.order - 1) + tokens_of(text)
        own = seq[self.order - 1:]
        c = [self.counts[1][(w,)] for w in own]
        return (len(own), sum(x > 0 for x in c), sum(math.log10((x + 1) / (self.N + self.V + 1)) for x in c),
                sum(math.log10(self.prob(tuple(seq[i:i + self.order]))) for i in range(len(own))))


def same(got, want):
    return got[:2] == want[:2] and np.allclose(got[2:], want[2:], rtol=1e-9, atol=1e-9)


def check(spark, train, rows, order):
    model = katz.fit(spark.createDataFrame([(t,) for t in train], "text string"), order=order)
    brute = Brute(train, order)
    assert (model.tokens, model.types) == (brute.N, brute.V)
    got = katz.score(model, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    left = {}
    for d, t in rows:
        left.setdefault(d, []).append(brute.score(t))
    for r in got:
        assert any(same(tuple(r)[1:], w) for w in left[r.doc_id]), (r, left[r.doc_id])
    return brute


@pytest.mark.parametrize("order", [1, 2, 3])
def test_random_texts(spark, order):
    rng = random.Random(order)
    words = ["the", "THE", "a", "of", "cat", "dog", "é", "runs", "sat.", "on"] + [f"w{i}" for i in range(40)]
    make = lambda: " ".join(rng.choices(words, k=rng.randint(0, 25), weights=[9] * 10 + [1] * 40))
    train = [make() for _ in range(80)] + ["", None, "the cat sat. on\tthe dog", "\x0b\x0c"]
    rows = [(i, make()) for i in range(20)] + [(50, None), (51, ""), (52, "unseen Words here"), (None, "the cat"), (50, None)]
    brute = check(spark, train, rows, order)
    vocabulary = [g[0] for g in brute.counts[1]]
    for h in list(brute.a[order])[:20]:
        total = sum(brute.prob((*h, w)) for w in vocabulary) + brute.prob((*h, "never seen"))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_documents(spark):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' limit 60").fetchall()]
    check(spark, texts[:45], list(enumerate(texts)), 2)


def test_keys_equal_sparks(spark):
    a, b = [1, -5, 2**62, 0], [7, 8, -(2**63), -1]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(list(zip(a, b)), "a long, b long").select(F.xxhash64("a", "b").alias("h"))
    want = katz.pair_key(np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64)).view(np.int64)
    assert [r.h for r in df.collect()] == want.tolist()


def test_pieces_do_not_change_words():
    text = ("word" * 400_000 + " " + "ab cd\n" * 300_000).encode()
    s = katz.sequence([text, b"", b"ab"], 2)
    assert np.bincount(s.doc).tolist() == [600_002, 1, 2]
    assert len(np.unique(s.key[1])) == 4


def test_no_training_and_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score double")
    model = katz.fit(empty)
    got = katz.score(model, spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert tuple(got[0]) == (1, 3, 0, 0.0, 0.0)
    assert katz.score(model, empty).count() == 0
