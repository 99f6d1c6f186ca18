"""Byte-level BPE against tiktoken and by round trip."""

import hashlib
import random
import time

import duckdb
import public_tokenizers
import pytest
import tiktoken

from loam.llm import bpe

NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
TEXTS = ["", " ", "a", "\n\n  \n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll I'm",
         "naïve Ñandú ciónñ  Straße", "日本語のテキスト 한국어", "👩‍👩‍👧‍👦 ok", "x" * 5000 + " " + "ab" * 3000,
         "12345678901234567890 1.5e10", "<|endoftext|>", "\u0000\u0001", "   leading and trailing   ", "!!!???***%%%###"]


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    ranks = bpe.read_ranks(public_tokenizers.path(request.param))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN), t


def tokens_of(encoder):
    return dict(zip(encoder.v.ids, encoder.v.tokens))


def test_same_ids_as_tiktoken(pair):
    ours, theirs = pair
    rng = random.Random(3)
    texts = TEXTS + [r[0] for r in duckdb.sql(
        "select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    tokens = tokens_of(ours)
    alphabet = "abcdeéñß THE the  \n\t.,!1239'sáü漢"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert bpe.decode(ids, tokens) == t.encode()


def test_random_letters(pair):
    ours, theirs = pair
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30)))
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_one_piece_takes_linear_time(pair):
    ours, _ = pair
    took = []
    for n in (40_000, 160_000):
        t0 = time.perf_counter()
        ours.encode("abcab" * (n // 5))
        took.append(time.perf_counter() - t0)
    assert took[1] < 16 * took[0]


def test_full_memo_tables_do_not_change_ids(pair, monkeypatch):
    ours, theirs = pair
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    t = "several words that fill the tables quickly, erthblewhan ououning"
    assert ours.encode(t) == theirs.encode_ordinary(t)


def test_documents(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(99, None, None), (None, "again", "x"), (None, "again", "x")]
    path = public_tokenizers.path(NAMES[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode_documents(df, path, public_tokenizers.PATTERN)).collect()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path),
                            special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(bpe.encode_documents(df.limit(0), path, public_tokenizers.PATTERN)).count() == 0
