"""Encoding and decoding of a table: one Python step, handed back in small parts, with all rows in place."""

import public_tokenizers
import tiktoken

from loam.llm import bpe


def test_one_python_step_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_IDS", 20)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [None, "", "a few words of a text " * 3, "", "one", "two three", "é" * 40, ""]
    df = spark.createDataFrame([(f"k{i % 5}", t) for i, t in enumerate(texts)], "name string, body string").coalesce(1)
    encoded = bpe.encode_documents(df, path, public_tokenizers.PATTERN, "body", "name")
    assert encoded.columns == ["name", "ids", "decoded"]
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan  # a second step would hold a second process a task
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = [(f"k{i % 5}", enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)]
    assert [(r["name"], r["ids"], bytes(r["decoded"])) for r in encoded.collect()] == want


def test_column_steps_still_agree(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    codec = bpe.Codec(df, path, public_tokenizers.PATTERN)
    apart = df.select("doc_id", codec.encode(df["text"]).alias("ids")).select("doc_id", "ids", codec.decode("ids").alias("decoded"))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, bpe.encode_documents(df, path, public_tokenizers.PATTERN).collect()))
