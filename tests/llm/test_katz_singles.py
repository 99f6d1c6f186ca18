"""The whole Katz model: n-grams seen once are stored with their discount, also by the registered query."""

import math
import random
from collections import Counter

import duckdb
import pytest

from loam.llm import katz
from loam.llm.common import held_out
from loam.llm.queries import QUERIES
from test_katz import Brute, same

SF = "/root/testdata/sf0.001"


class Whole(Brute):
    """The model by dictionaries, from n-grams of all counts."""

    def __init__(self, texts, order):
        super().__init__(texts, order)
        for n in range(2, order + 1):
            self.p[n], self.a[n] = {}, {}
            follows, followed = {}, Counter()
            kept = self.kept(n)
            for g, c in self.counts[n].items():
                follows.setdefault(g[:-1], []).append(g)
                followed[g[:-1]] += c
            for h, own in follows.items():
                left = sum(kept[g] for g in own)
                of = followed[h] + (left >= followed[h] * (1 - 1e-12))
                self.a[n][h] = (1 - left / of) / (1 - sum(self.p[n - 1][g[1:]] for g in own))
                for g in own:
                    self.p[n][g] = kept[g] / of


@pytest.mark.parametrize("order", [2, 3])
def test_random_texts(spark, order):
    rng = random.Random(order)
    words = [f"w{i}" for i in range(60)]
    make = lambda: " ".join(rng.choices(words, k=rng.randint(0, 25), weights=[30 / (i + 1) for i in range(60)]))
    train = [make() for _ in range(150)] + ["", None]
    rows = [(i, make()) for i in range(20)] + [(50, None), (51, "unseen Words here"), (None, train[0])]
    brute = Whole(train, order)
    assert katz.discounts(Counter(brute.counts[order].values()))[1] < 1
    model = katz.fit(spark.createDataFrame([(t,) for t in train], "text string"), order=order, least=1)
    stored = model.grams.where(f"level = {order}").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in stored} == Counter(brute.counts[order].values())
    want = {d: brute.score(t) for d, t in rows}
    got = katz.score(model, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(same(tuple(r)[1:], want[r.doc_id]) for r in got)
    vocabulary = [g[0] for g in brute.counts[1]]
    for h in list(brute.a[order])[:20]:
        total = sum(brute.prob((*h, w)) for w in vocabulary) + brute.prob((*h, "never seen"))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = [r.text for r in docs.where(~held_out("doc_id", 7)).collect()]
    brute = Whole(train, katz.ORDER)
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op5_katz_scores"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert same((r.n_tokens, r.n_known, r.base_score, r.score), brute.score(texts[r.doc_id])), r.doc_id
