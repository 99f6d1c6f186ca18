"""Byte-level BPE encoding and decoding.

The vocabulary's tokens, bytes mapped to Latin-1 characters, go into an Aho-Corasick
automaton, which gives the longest token at every position of a piece.  Encoding
takes longest matches from left to right; a token may follow another only if merging
by rank would never join them across their border.  That compatibility is worked
out from the last merge of each token and memoised.  Where no compatible token is
left, the encoder backs up by one token and never tries that position again, so the
work is linear in the piece and the result equals merging by rank.

The rank file is read on the driver; its split table (two integers a token) goes to
the executors, which build the automaton once per Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import text_or_empty

#: Entries of the memo tables of a worker; a full table is emptied and filled anew.
MEMO_PIECES = 300_000
MEMO_PAIRS = 400_000
#: Ids that ``Codec.round_trip`` hands back at once, and the bytes decoded from them.
PART_IDS = 1 << 18

_WORKER: dict[bytes, "Encoder"] = {}
_TOKENS: dict[bytes, dict[int, bytes]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by rank, their last merges, and the tokens that merging can produce."""

    def __init__(self, ranks: dict[bytes, int]):
        order = sorted(ranks.items(), key=lambda kv: kv[1])
        self.ids = [r for _, r in order]
        self.tokens = [t for t, _ in order]
        index = {t: i for i, t in enumerate(self.tokens)}
        if any(len(t) == 1 and i >= 256 for t, i in index.items()) or len([t for t in self.tokens if len(t) == 1]) != 256:
            raise ValueError("the 256 single bytes must have the smallest ranks")
        n = len(self.tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.pairs: dict[int, int] = {}
        self.reachable = [i < 256 for i in range(n)]
        for i in range(256, n):
            token = self.tokens[i]
            for cut in range(len(token) - 1, 0, -1):
                a, b = index.get(token[:cut], n), index.get(token[cut:], n)
                if a < i and b < i and self.reachable[a] and self.reachable[b] and self.compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.pairs[a << 32 | b] = i
                    self.reachable[i] = True
                    break

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a and b side by side as they are.

        Undoes merges from the highest rank down, looking at the two tokens that touch
        the border: any token that joins them earlier than the one undone would win.
        """
        pairs, left, right = self.pairs, self.left, self.right
        limit = 1 << 62
        while True:
            joined = pairs.get(a << 32 | b)
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True


class Encoder:
    """Encoder of one worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        if len(vocabulary.tokens) > 1 << 16:
            raise ValueError("pairs of tokens are packed into 32 bits")
        self.pieces = regex.compile(pattern).findall
        self.whole = {t: (i,) for t, i in zip(vocabulary.tokens, vocabulary.ids)}
        self.length = [len(t) for t in vocabulary.tokens]
        self.automaton = ahocorasick.Automaton()
        known = {t: i for i, t in enumerate(vocabulary.tokens) if vocabulary.reachable[i]}
        for t, i in known.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((known[t[:cut]] for cut in range(len(t) - 1, 0, -1) if t[:cut] in known), -1)
                        for t in vocabulary.tokens]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        found = self.whole.get(raw)
        if found is None:
            found = tuple(self.v.ids[t] for t in self.split(raw))
        if len(self.memo) >= MEMO_PIECES:
            self.memo.clear()
        if len(piece) <= 64:
            self.memo[piece] = found
        return found

    def split(self, raw: bytes) -> list[int]:
        """Indices of the tokens that merging by rank gives."""
        chars = raw.decode("latin-1")
        fits, compatible, longest = self.fits, self.v.compatible, self.automaton.iter_long
        out: list[int] = []
        add = out.append
        last = -1
        for end, token in longest(chars):  # longest matches, as long as each may follow the one before
            if last >= 0:
                ok = fits.get(last << 16 | token)
                if ok is None:
                    if len(fits) >= MEMO_PAIRS:
                        fits.clear()
                    ok = fits[last << 16 | token] = compatible(last, token)
                if not ok:
                    return self.backtrack(chars, out, end + 1 - self.length[token], token)
            add(token)
            last = token
        return out

    def backtrack(self, chars: str, out: list[int], at: int, token: int) -> list[int]:
        """Go on from ``at``, where ``token`` may not follow the last token of ``out``."""
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.v.compatible
        longest = self.automaton.iter_long
        n = len(chars)
        free = bytearray(b"\1") * (n + 1)
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if free[end]:
                    ok = last < 0 or fits.get(last << 16 | token)
                    if ok is None:
                        if len(fits) >= MEMO_PAIRS:
                            fits.clear()
                        ok = fits[last << 16 | token] = compatible(last, token)
                    if ok:
                        out.append(token)
                        at = end
                        if at < n:
                            token = next(longest(chars, at))[1]
                        break
                token = shorter[token]
                if token < 0:  # nothing fits here: give up this border and shorten the token before it
                    free[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo, extend, piece = self.memo, out.extend, self.piece
        for p in self.pieces(text):
            extend(memo.get(p) or piece(p))
        return out


def decode(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    """Bytes of token ids."""
    return b"".join(map(tokens.__getitem__, ids))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int32)))


class Codec:
    """Encodes and decodes columns with one vocabulary and split pattern."""

    def __init__(self, df: DataFrame, ranks_path: str, pattern: str):
        vocabulary = Vocabulary(read_ranks(ranks_path))
        shared = df.sparkSession.sparkContext.broadcast((vocabulary, pattern))
        name, most = f"{ranks_path}\0{pattern}".encode(), PART_IDS

        def worker() -> Encoder:
            if name not in _WORKER:
                _WORKER[name] = Encoder(*shared.value)
            return _WORKER[name]

        def tokens() -> dict[int, bytes]:
            if name not in _TOKENS:  # a worker that only decodes needs no automaton
                _TOKENS[name] = dict(zip(shared.value[0].ids, shared.value[0].tokens))
            return _TOKENS[name]

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            e = worker()
            return _lists([np.array(e.encode(t.as_py()), np.int32) for t in texts])

        @F.arrow_udf("binary")
        def decode_ids(ids: pa.Array) -> pa.Array:
            known = tokens()
            return pa.array([decode(x.values.to_numpy(zero_copy_only=False).tolist(), known) for x in ids], pa.binary())

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e, known = worker(), tokens()

            def part(keys: pa.Array, ids: list[np.ndarray], raws: list[bytes]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([keys, _lists(ids), pa.array(raws, pa.binary())], ["key", "ids", "decoded"])

            for b in batches:
                ids, raws, at, size = [], [], 0, 0
                for row, text in enumerate(b.column(1)):
                    found = e.encode(text.as_py())
                    raws.append(decode(found, known))
                    ids.append(np.array(found, np.int32))
                    size += len(found)
                    if size >= most:
                        yield part(b.column(0).slice(at, len(ids)), ids, raws)
                        ids, raws, at, size = [], [], row + 1, 0
                if ids:
                    yield part(b.column(0).slice(at, len(ids)), ids, raws)

        # otherwise Spark folds both into one step that encodes once more for decoding
        self._encode, self._decode, self._both = encode.asNondeterministic(), decode_ids, both

    def encode(self, text: Column) -> Column:
        """Token ids of a non-NULL text column."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of an array column of ids."""
        return self._decode(ids)

    def round_trip(self, rows: DataFrame) -> DataFrame:
        """key, ids, decoded of rows (key, non-NULL text).

        One worker encodes a text and decodes its ids, so a task needs one Python process, not one for each
        step, and what it hands back comes in parts of about ``PART_IDS`` ids, however long the rows it got.
        """
        key = rows.schema.fields[0]
        return rows.mapInArrow(self._both, T.StructType([key, T.StructField("ids", T.ArrayType(T.IntegerType())),
                                                         T.StructField("decoded", T.BinaryType())]))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                     key: str = "doc_id") -> DataFrame:
    """key, ids (array of token ids), decoded (bytes) of every row.

    NULL text counts as empty and gives no ids.  Every row is encoded on its own, so
    repeated rows repeat and long texts need memory for one text at a time.
    """
    return Codec(docs, ranks_path, pattern).round_trip(docs.select(key, text_or_empty(text).alias("text")))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of ``encode_documents``."""
    return encoded.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
