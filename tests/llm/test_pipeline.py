"""The pipeline stage by stage against brute-force decisions."""

import hashlib

import duckdb
import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline
from loam.llm import bpe, line_quality
from loam.llm.common import held_out, saved
from test_decontaminate import brute as brute_leaks
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, SF), "test")
        out[name] = (before, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "simhash near dedup", "benchmark decontamination", "byte bpe"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == columns, name


def test_quality_rejects_what_scores_low(stages, spark):
    before, after = stages["quality classifier"]
    model = line_quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out("doc_id", 4)))
    all_texts = texts(before)
    ids = sorted(all_texts)
    scores = dict(zip(ids, line_quality.score_texts(model, [all_texts[d] for d in ids])))
    assert set(texts(after)) == {d for d in ids if scores[d] >= 0.7}
    good = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    kept = set(texts(after))
    assert sum(d in kept for d, q in good.items() if q == 1) > 0.95 * sum(good.values())


def test_exact_keeps_the_largest_id(stages):
    before, after = (texts(x) for x in stages["exact dedup"])
    want = {}
    for d, t in before.items():
        want[t] = max(want.get(t, d), d)
    assert set(after) == set(want.values())


def test_near_keeps_one_of_each_component(stages):
    before, after = (texts(x) for x in stages["simhash near dedup"])
    comp = brute_components({d: brute_fingerprint(t) for d, t in before.items()})
    assert set(after) == set(comp.values())


def test_benchmark_passages_go(stages):
    before, after = (texts(x) for x in stages["benchmark decontamination"])
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    leaks = {d for d, _ in brute_leaks(list(before.items()), items)}
    assert leaks and set(after) == set(before) - leaks


def test_encoding_of_what_is_left(stages):
    before, after = stages["byte bpe"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for d, t in texts(before).items():
        ids = enc.encode_ordinary(t)
        want.add((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    assert {tuple(r) for r in after.collect()} == want


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "Some text.", "en", "s", 10),
            (2, "Some text.", "en", "s", 10), (3, "long " * 20000, "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs.select("*"), SF)
            assert got.count() <= n, name
            assert name == "byte bpe" or got.columns == docs.columns
    assert STAGES["exact dedup"](spark, spark.createDataFrame(rows, schema), SF).count() == 3
