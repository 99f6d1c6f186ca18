"""Copies of a text fill one place of a language's sample, however many there are."""

import random

from pyspark.sql import functions as F

from loam.llm import language as g


def test_copies_do_not_crowd_the_sample(spark):
    rng = random.Random(3)
    rows = [(lang, " ".join("".join(rng.choices(letters, k=5)) for _ in range(90)))
            for lang, letters in (("xa", "abcdefgh"), ("xb", "efghijkl")) for _ in range(80)]
    df = spark.createDataFrame(rows, "lang string, text string")
    least = df.where("lang = 'xa'").orderBy(F.xxhash64("text")).first().text
    copied = df.unionByName(spark.createDataFrame([("xa", least)] * 1000, "lang string, text string"))
    plain, model = g.fit(df), g.fit(copied)
    assert model.langs == plain.langs and model.sizes == plain.sizes
    assert all((a == b).all() for a, b in zip(model.tables, plain.tables))
