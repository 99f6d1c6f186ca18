"""Documents whose extra columns bear the names that the operators use inside."""

import pytest

from loam.llm import decontaminate, exact_dedup, language, merkle, mixing, pii, secret_scan, simhash, whitening
from loam.llm.common import unused

NAMES = ["k_", "s_", "n_", "p_", "r_", "K_", "k", "clean", "place", "at_", "part_", "bent", "g", "h", "fp", "row"]
TEXT = "Anna has 12 apples and gives 5 kg of them to Bert, then Anna buys 1,200 more apples. How many does Anna have now?"


@pytest.fixture
def docs(spark):
    names = [n for i, n in enumerate(NAMES) if n.lower() not in [m.lower() for m in NAMES[:i]]]
    rows = [(i, t, "en", s, 1, *range(len(names))) for i, (t, s) in enumerate(
        [(TEXT, "a"), (TEXT, "a"), ("nothing here but words and more of them", None), (None, "b"), ("", "b")])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{n}` int" for n in names))


def test_unused(docs):
    assert unused(docs, "k_", "new") == ["k__", "new"]


def test_operators(spark, docs):
    item = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    kept = decontaminate.clean(docs, item)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    found = language.predict(language.fit(docs), docs)
    assert found.columns == [*docs.columns, "lang_pred", "score"] and found.count() == 5
    changed = pii.pseudonymise(docs, b"k")
    assert changed.columns == [*docs.columns, "pii_spans"] and changed.count() == 5
    assert secret_scan.find_secrets(docs).count() >= 0
    assert merkle.manifest(docs).where("doc_id is not null").count() == 5
    assert mixing.mix(docs).count() == 5


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1, 2) for i in range(9)], "vec_id long, embedding array<float>, n int, component int")
    assert whitening.whiten(df).count() == 18
