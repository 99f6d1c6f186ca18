"""Language identification: phrases against brute force, held-out accuracy, edge cases."""

import random

import numpy as np

from loam.llm import language as g
from loam.llm.common import held_out


def brute_phrases(symbols, sample):
    """Greedy longest matches by substring search."""
    n = at = 0
    hay = "".join(chr(64 + s) for s in sample)
    text = "".join(chr(64 + s) for s in symbols)
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at:at + k] in hay:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_brute_force():
    rng = random.Random(0)
    for _ in range(40):
        sample = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        table = g.suffix_automaton(sample, 5)
        texts = sorted(([rng.randint(0, 4) for _ in range(rng.randint(1, 30))] for _ in range(8)), key=len, reverse=True)
        blocks = np.zeros((30, 8), np.int32)
        for k, t in enumerate(texts):
            blocks[:len(t), k] = t
        got = g.phrases(blocks, np.array([len(t) for t in texts]), table)
        assert got.tolist() == [brute_phrases(t, sample) for t in texts]


def test_blocks_cover_whole_texts():
    rng = random.Random(1)
    sample = [rng.randint(1, 4) for _ in range(300)]
    table, symbols = g.suffix_automaton(sample, 5), np.arange(5, dtype=np.int32)
    texts = [[rng.randint(1, 4) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    got = g._parse([np.array(t, np.uint32) for t in texts], [table], symbols)
    want = [sum(brute_phrases(t[i:i + g.BLOCK], sample) for i in range(0, len(t), g.BLOCK)) for t in texts]
    assert got[:, 0].tolist() == want


def test_folding():
    points, has = g.fold("Ab,, ÇÉ 12!\n漢x")
    assert "".join(map(chr, points)) == "ab çé 漢x" and has
    assert g.fold("12 !?")[1] is False and g.fold("")[1] is False


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = g.fit(docs.where(~held_out("doc_id", 4)))
    got = g.predict(model, docs.where(held_out("doc_id", 4))).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    rows = [(1, "the cat sat on the mat and then the dog ran", "en", "a"), (2, "der hund und die katze auf der matte", "de", "b"),
            (3, None, "en", "c"), (4, "", "de", "d"), (5, "123 456", "en", "e"), (6, "the dog", None, "f"),
            (6, "the dog", None, "f"), (None, "die katze " * 3000, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred) for r in g.predict(g.fit(df), df).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de")}
    none = g.predict(g.fit(df.limit(0)), df).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(rows)
    assert g.predict(g.fit(df), df.limit(0)).count() == 0
