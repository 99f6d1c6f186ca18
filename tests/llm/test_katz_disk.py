"""Counts of n-grams are written once, where they were added up, and a frequent word's n-grams stay together."""

import random
from pathlib import Path

from loam.llm import katz
from loam.llm.common import dropped

from test_katz_singles import Whole
from test_katz import same


def size(df):
    return sum(Path(f.removeprefix("file:").replace("///", "/")).stat().st_size for f in set(df.inputFiles()))


def test_model_takes_little_more_than_its_histories(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) for _ in range(60)]
    model = katz.fit(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), least=1)
    grams = model.grams.count()
    assert grams > 100_000
    # a history of 8 bytes, the rest of an n-gram in less than 8 (as rows with key, value, count and weight: over 16)
    assert size(model.table) + size(model.weights) < 16 * grams


def test_scores_outlive_the_model(spark):
    texts = ["a b c a b", "the cat a b", None, "", "B the\tthe"]
    model = katz.fit(spark.createDataFrame([(t,) for t in texts], "text string"), least=1)
    scored = katz.score(model, spark.createDataFrame([(1, "a b the dog"), (None, None)], "doc_id long, text string"))
    files = model.table.inputFiles()
    dropped(model.table)
    assert files and not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files)
    brute = Whole(texts, katz.ORDER)
    assert {r.doc_id: same(tuple(r)[1:], brute.score(t)) for r, t in zip(
        sorted(scored.collect(), key=lambda r: r.doc_id is None), ["a b the dog", None])} == {1: True, None: True}


def test_batches_and_rounds_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(30))) for _ in range(60)]
    brute = Whole(texts, 3)
    monkeypatch.setattr(katz, "ROUNDS", 3)
    model = katz.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3, least=1)
    got = katz.score(model, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and all(same(tuple(r)[1:], brute.score(texts[r.doc_id])) for r in got)
