"""Language-model scoring with Katz back-off.

n-grams of every training text are counted, counts up to ``GOOD_TURING`` are discounted
by Good-Turing estimates, and what the discounts (and, with ``least`` over 1, the n-grams
of order 2 and up seen less often, which are not stored) leave goes to the next lower order
through weights that make every distribution sum to one exactly.  Unknown words share one unknown token, which gets
what the unigram discounts leave.  A token's probability is looked up at the highest order
and otherwise taken from the order below times its history's weight, and so on down.

Words are 64-bit hashes; an n-gram is the pair of its first n - 1 and its last n - 1 words
(``hist`` and ``tail``), hashed by Spark's xxhash64 on both sides.  The model is a table of counts
bucketed by hash range of the last word, in packed sorted arrays, and a small one of weights of histories;
probabilities are worked out of the counts where they are needed.

Scale: a task counts n-grams of a few megabytes of text at a time and sends each once per
such piece, as sorted arrays cut by hash range (``bucket``).  Counts are written where they were added
up and never move again: an n-gram's tail stands in its bucket, so only sums per history travel.
For scoring, texts are turned into numbered words where they are read, and written in batches of such pieces; a
batch asks every bucket of the model for its distinct n-grams, again in sorted arrays, and gets back their counts.  So a
frequent n-gram costs one entry per piece or batch, however hot it is, and no task holds
more than one piece, batch or bucket.  Nothing but the few counts of counts reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from loam.llm.common import bucketed, dropped, pack, saved, shuffle_parts, text_or_empty, unpack

ORDER = 2
GOOD_TURING = 5
#: Bytes of text counted, or scored, at once.
PIECE = 16 << 20
#: Parts of the model that are asked one after the other, so that only the requests for one are on disk.
ROUNDS = 2

BEGIN = np.uint64(xxhash.xxh64_intdigest(b" "))  # white space: no word hashes like these by intent
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))

# XXH64 constants and the seed that Spark's xxhash64 starts from (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SEED = np.uint64(42)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0


def _left(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _P5 + np.uint64(8)
    h = _left(h ^ (_left(x * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_key(hist: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(hist, tail)."""
    return _hash_long(tail, _hash_long(hist, np.full(1, _SEED)))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a lower-cased byte array."""
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    raw = raw[starts[0]:]
    spans = np.diff(np.append(starts, starts[0] + len(raw)))  # with the white space behind
    place = np.arange(len(raw)) - np.repeat(starts - starts[0], spans)
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(spans.max()), _P1)))
    h = np.add.reduceat(_BYTE[raw] * powers[place], starts - starts[0])
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29)), starts


@dataclass
class Sequence:
    """Tokens of several texts: distinct word hashes, each token's place among them, and tokens of each text (its end is one)."""
    words: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    order: int

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def key(self) -> dict[int, np.ndarray]:
        return {1: self.words[self.codes]}

    def grams(self, buckets: int, every: bool = False) -> Iterator[Grams]:
        """The n-grams of order 1, 2 and so on; ``every``: with the places of the tokens' own also in the last order."""
        words = np.append(self.words, BEGIN)
        own = bucket_of(words, buckets)
        by = np.lexsort((words, own))
        rank = np.empty(len(words), np.uint32)
        rank[by] = np.arange(len(words), dtype=np.uint32)
        pads = (self.order - 1) * np.arange(1, len(self.sizes) + 1)
        real = np.arange(len(self.codes)) + np.repeat(pads, self.sizes)  # places of tokens when each text begins with pads
        place = np.full(len(self.codes) + len(self.sizes) * (self.order - 1), rank[-1])
        place[real] = rank[self.codes]
        keys, own = words[by], own[by]
        hist = tail = None
        for n in range(1, self.order + 1):
            before = None
            if n > 1:  # tail's place, then history's: in the order of the last words' buckets, whatever n
                pairs = place.astype(np.uint64) << np.uint64(32)
                pairs[1:] |= place[:-1]
                if n == self.order:
                    before, pairs = place[real - 1] if every else None, pairs[real]
                elif every:
                    before = place[real - 1]
                if n == self.order and not every:
                    pairs, count = np.unique(pairs, return_counts=True)
                else:
                    pairs, place = np.unique(pairs, return_inverse=True)
                    place = place.astype(np.uint32)
                h, t = pairs & np.uint64(0xFFFFFFFF), pairs >> np.uint64(32)
                hist, tail, own = keys[h], keys[t], own[t]
                keys = pair_key(hist, tail)
            else:
                hist, tail = np.zeros(len(keys), np.uint64), keys
            if n > 1 and n == self.order:
                mine = place if every else None
                count = None if every else count
            else:
                mine = place[real]
                count = np.bincount(mine, minlength=len(keys))
            yield Grams(n, hist, tail, keys, own, count, mine, before)


@dataclass
class Grams:
    """Distinct n-grams of an order by their buckets, how often each is a token's, and by token the places of its own and of its history."""
    n: int
    hist: np.ndarray
    tail: np.ndarray
    key: np.ndarray
    own: np.ndarray
    count: np.ndarray | None
    mine: np.ndarray | None
    before: np.ndarray | None

    def runs(self, buckets: int) -> list[tuple[int, slice]]:
        edges = np.searchsorted(self.own, np.arange(buckets + 1))
        return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def sorted_runs(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Per bucket the places of its n-grams, by key."""
        return [(k, x.start + np.argsort(self.key[x])) for k, x in self.runs(buckets)]


def sequence(texts: list[bytes], order: int) -> Sequence:
    """Words of each text and its end, in order."""
    raw = np.frombuffer(b"\n".join(t.lower() for t in texts), np.uint8)  # bytes.lower knows A-Z only
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    parts, at = [], 0
    while at < len(raw):  # in bounded pieces that end with white space
        to = min(len(raw), at + (1 << 20))
        while to < len(raw) and not _SPACE[raw[to - 1]]:
            to = min(len(raw), to + (1 << 10))
            back = np.flatnonzero(_SPACE[raw[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
        h, starts = word_hashes(raw[at:to])
        parts.append((h, starts + at))
        at = to
    words = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
    starts = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    ends = np.searchsorted(starts, begins)
    words, codes = np.unique(np.insert(words, ends[1:], END), return_inverse=True)
    return Sequence(words, codes.astype(np.uint32), np.diff(ends) + 1, order)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


#: Stored n-grams of a bucket, in runs of at most ``RUN``: (hist, tail, c) packed, sorted by tail, and what all orders' totals need.
RUN = 1 << 16
STORED = "bucket int, n int, hist binary, tail binary, c binary, types long, total long, ends long, seen array<long>"


def _arrow(kind: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(kind).fields])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _joined(packed: Iterable[bytes], kind: type, ordered: bool = False) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[unpack(x, kind, ordered) for x in packed]])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of the batches' rows, the first of them bytes, for about ``PIECE`` of these at a time."""
    held, size = [], 0
    for b in batches:
        for row in zip(*b.columns):
            held.append([x.as_py() for x in row])
            size += len(held[-1][0])
            if size >= PIECE:
                yield [list(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(x) for x in zip(*held)]


def _count(texts: DataFrame, order: int, buckets: int, least: int) -> DataFrame:
    """``STORED`` n-gram counts of the texts (raw); from order 2 on only of ``least`` and more.

    The bucket is that of an n-gram's last word, so the n-grams that its tails are stand in the same one.
    """
    sent, stored = _arrow("bucket int, n int, hist binary, tail binary, c binary"), _arrow(STORED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, in pieces(batches):
            for g in sequence(texts, order).grams(buckets):
                rows = []
                for k, x in g.runs(buckets):
                    seen = g.count[x] > 0  # what only stands before a text does not count
                    if seen.any():
                        rows.append((k, g.n, pack(g.hist[x][seen]), pack(g.tail[x][seen], ordered=True), pack(g.count[x][seen].astype(np.uint32))))
                yield from _table(rows, sent).to_batches()

    def add(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for n in range(1, order + 1):
            own = [r for r in rows if r["n"] == n]
            if not own:
                continue
            hist, tail = _joined((r["hist"] for r in own), np.uint64), _joined((r["tail"] for r in own), np.uint64, ordered=True)
            c = _joined((r["c"] for r in own), np.uint32).astype(np.int64)
            by = np.lexsort((hist, tail))
            hist, tail = hist[by], tail[by]
            first = np.flatnonzero(np.append(True, (hist[1:] != hist[:-1]) | (tail[1:] != tail[:-1])))
            hist, tail, c = hist[first], tail[first], np.add.reduceat(c[by], first)
            if n > 1 and least > 1:
                hist, tail, c = (x[c >= least] for x in (hist, tail, c))
            for i in range(0, len(c), RUN):
                h, t, m = (x[i:i + RUN] for x in (hist, tail, c))
                out.append((rows[0]["bucket"], n, pack(h), pack(t, ordered=True), pack(m), len(m), int(m.sum()),
                            int(m[t == END].sum()) if n == 1 else 0, np.bincount(m[m <= GOOD_TURING + 1], minlength=GOOD_TURING + 2).tolist()))
        return _table(out, stored)

    return texts.select("raw").mapInArrow(count, "bucket int, n int, hist binary, tail binary, c binary") \
        .groupBy("bucket").applyInArrow(add, STORED)


def _held(grams: pa.Table, levels: Iterable[int]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per order (key, hist, tail, c) of a bucket's n-grams, by key."""
    out, orders = {}, grams["n"].to_numpy()
    for n in levels:
        own = np.flatnonzero(orders == n)
        hist, tail, c = (_joined((grams[x][int(i)].as_py() for i in own), kind, x == "tail")
                         for x, kind in (("hist", np.uint64), ("tail", np.uint64), ("c", np.int64)))
        key = tail if n == 1 else pair_key(hist, tail)
        by = np.argsort(key)
        out[n] = (key[by], hist[by], tail[by], c[by])
    return out


def _places(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``have``, and whether they are there."""
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def discounts(of_count: dict[int, int], top: int = GOOD_TURING) -> dict[int, float]:
    """Katz discounts d[r] of counts r = 1 .. top from the numbers of n-grams seen r times (1 where estimates fail)."""
    n = [of_count.get(r, 0) for r in range(top + 2)]
    out = {r: 1.0 for r in range(1, top + 1)}
    cut = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    if cut >= 1:
        return out
    for r in range(1, top + 1):
        if n[r] and n[r + 1]:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
            if 0 < d < 1:
                out[r] = d
    return out


@dataclass
class Model:
    """What scoring needs: counts (``STORED``, by bucket), histories' weights, discounts, and the totals of the training tokens.

    weights: bucket, level, keys, of (what a history's discounted counts are divided by), weight (log10), packed.
    """
    table: DataFrame
    weights: DataFrame
    discounts: dict[int, dict[int, float]]
    scale: float
    buckets: int
    order: int
    tokens: int
    types: int
    unknown: float

    @property
    def grams(self) -> DataFrame:
        """level, bucket, key, c: every stored n-gram."""
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    hist, tail, c = unpack(r["hist"], np.uint64), unpack(r["tail"], np.uint64, ordered=True), unpack(r["c"], np.int64)
                    key = tail if r["n"] == 1 else pair_key(hist, tail)
                    yield pa.record_batch([pa.array(np.full(len(c), r["n"], np.int32)), pa.array(np.full(len(c), r["bucket"], np.int32)),
                                           pa.array(key.view(np.int64)), pa.array(c)], names=["level", "bucket", "key", "c"])
        return self.table.select("bucket", "n", "hist", "tail", "c").mapInArrow(spread, "level int, bucket int, key long, c long")


def discounted(c: np.ndarray, by: dict[int, float]) -> np.ndarray:
    out = c.astype(np.float64)
    for r, d in by.items():
        out[c == r] = d * r
    return out


WEIGHTS = "bucket int, level int, keys binary, of binary, weight binary"


def fit(train: DataFrame, text: str = "text", order: int = ORDER, least: int = 2) -> Model:
    """Count, discount and normalise.  NULL text is empty and still has its end; repeated rows count again.

    n-grams of order 2 and up are stored if seen ``least`` (1 or 2) times: 1 is the whole model, 2 a smaller
    one that leaves those seen once to back-off.
    """
    if least not in (1, 2):  # the numbers of n-grams seen 2 times and more are needed whole
        raise ValueError("least must be 1 or 2")
    raw = train.select(text_or_empty(text).cast("binary").alias("raw"))
    buckets = 2 * shuffle_parts(train.sparkSession)
    # bucketed, so that the n-grams are never moved again: what is asked or told about them comes to them
    table = bucketed(_count(raw, order, buckets, least), "bucket", "counts", dealt=True)
    totals = {r["n"]: r for r in table.groupBy("n").agg(
        F.sum("total").alias("total"), F.sum("types").alias("types"), F.sum("ends").alias("ends"),
        *[F.sum(F.col("seen")[r]).alias(f"seen{r}") for r in range(1, GOOD_TURING + 2)]).collect()}
    tokens, types, docs = (totals[1][x] if 1 in totals else 0 for x in ("total", "types", "ends"))
    seen = {n: {r: totals[n][f"seen{r}"] for r in range(1, GOOD_TURING + 2)} if n in totals else {} for n in range(1, order + 1)}
    if least == 2:
        for n in range(2, order + 1):
            seen[n][1] = tokens - (totals[n]["total"] if n in totals else 0)  # each token ends one n-gram, so the rest were seen once
    by = {n: discounts(seen[n]) for n in range(1, order + 1)}
    mass = (tokens - sum((1 - d) * r * seen[1].get(r, 0) for r, d in by[1].items())) / max(tokens, 1)
    # no estimate left anything: one token in tokens + 1 is unknown
    scale = 1.0 if 1 - mass >= 1 / (tokens + 1) else (1 - 1 / (tokens + 1)) / mass
    unknown = float(np.log10(1 - scale * mass)) if tokens else 0.0

    grams = table.select("bucket", "n", "hist", "tail", "c")
    parted, weighed, telling = (_arrow(x) for x in (
        "to int, source int, hist binary, kept binary, below binary", WEIGHTS, "bucket int, n int, hist binary, of binary"))

    def weights_of(n: int, pad: np.uint64, told: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Weights of the histories of order n, and of orders before the last also what shares of the next one need."""
        def shares(grams: pa.Table, told: pa.Table | None = None) -> pa.Table:
            """Per history of order n that a bucket holds: its discounted counts, and the lower probabilities of what follows it."""
            if not grams.num_rows:
                return _table([], parted)
            held, chance, last = _held(grams, range(1, n + 1)), None, None
            for m in range(1, n + 1):
                _, hist, tail, c = held[m]
                if m == 1:
                    chance = discounted(c, by[1]) * scale / max(tokens, 1)
                    continue
                at, _ = _places(held[m - 1][0], tail)
                below, last = chance[at], hist if m == 2 else last[at]  # the last word of the history is its tail's
                if m < n:
                    own = [r for r in told.to_pylist() if r["n"] == m]
                    have, of = _joined((r["hist"] for r in own), np.uint64, ordered=True), _joined((r["of"] for r in own), np.int64)
                    order_of = np.argsort(have)
                    at, _ = _places(have[order_of], hist)
                    chance = discounted(c, by[m]) / of[order_of[at]]
            h, first, of_gram = np.unique(hist, return_index=True, return_inverse=True)
            kept, below, to = np.bincount(of_gram, discounted(c, by[n])), np.bincount(of_gram, below), bucket_of(last[first], buckets)
            place = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[place], np.arange(buckets + 1))
            return _table([(k, grams["bucket"][0].as_py(), pack(h[x], ordered=True), pack(kept[x]), pack(below[x]))
                           for k, x in enumerate(place[a:b] for a, b in zip(edges, edges[1:])) if len(x)], parted)

        def weigh(parts: pa.Table, grams: pa.Table) -> pa.Table:
            """Weights of the histories of order n of a bucket."""
            rows = parts.to_pylist()
            if not rows:
                return _table([], weighed)
            h, of_part = np.unique(_joined((r["hist"] for r in rows), np.uint64, ordered=True), return_inverse=True)
            kept, below = (np.bincount(of_part, _joined((r[x] for r in rows), np.float64)) for x in ("kept", "below"))
            key, _, _, c = _held(grams, [n - 1])[n - 1]
            at, there = _places(key, h)
            # how often each history was followed: its own count, and the number of texts for their beginning
            followed = np.where(there, c[at] if len(c) else 0, 0)
            followed[h == pad] = docs
            # a history whose discounts leave nothing is taken to be followed once more
            of = followed + (kept >= followed * (1 - 1e-12))
            weight = np.log10((1 - kept / of) / np.maximum(1 - below, 1e-15))
            return _table([(rows[0]["to"], n - 1, pack(h[i:i + RUN], ordered=True), pack(of[i:i + RUN]), pack(weight[i:i + RUN]))
                           for i in range(0, len(h), RUN)], weighed)

        def tell(parts: pa.Table, weights: pa.Table) -> pa.Table:
            """What the bucket of a history knows, to the buckets that asked."""
            own = weights.to_pylist()
            keys, of = _joined((r["keys"] for r in own), np.uint64, ordered=True), _joined((r["of"] for r in own), np.int64)
            by_key = np.argsort(keys)
            return _table([(r["source"], n, r["hist"], pack(of[by_key[_places(keys[by_key], unpack(r["hist"], np.uint64, ordered=True))[0]]]))
                           for r in parts.to_pylist()], telling)

        low, kind = grams.where(F.col("n") <= n).groupBy("bucket"), "to int, source int, hist binary, kept binary, below binary"
        parts = low.applyInArrow(lambda g: shares(g), kind) if told is None else \
            low.cogroup(told.groupBy("bucket")).applyInArrow(shares, kind)
        if n < order:
            parts = saved(parts, "parts")
        weights = saved(parts.groupBy("to").cogroup(grams.where(F.col("n") == n - 1).groupBy("bucket")).applyInArrow(weigh, WEIGHTS), f"weights{n}")
        if n < order:
            answers = saved(parts.groupBy("to").cogroup(weights.groupBy("bucket")).applyInArrow(
                tell, "bucket int, n int, hist binary, of binary"), f"told{n}")
            dropped(parts)
            told = answers if told is None else told.unionByName(answers)
        return weights, told

    pad, weights, told = np.full(1, BEGIN), None, None
    for n in range(2, order + 1):
        own, told = weights_of(n, pad[0], told)
        weights = own if weights is None else weights.unionByName(own)
        pad = pair_key(pad, pad)
    if told is not None:
        dropped(told)
    if weights is None:
        weights = train.sparkSession.createDataFrame([], WEIGHTS)
    return Model(grams, weights, by, scale, buckets, order, tokens, types, unknown)


def score(model: Model, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_tokens, n_known, base_score, score (log10 probability of the text).

    The model is asked at once, not when the result is read.  An empty or NULL text is its end alone.  Equal rows are scored alike.
    """
    order, tokens, types, unknown, buckets = model.order, model.tokens, model.types, model.unknown, model.buckets
    by_level, scale = model.discounts, model.scale
    kind = docs.schema[key].dataType.simpleString()
    own_type = to_arrow_type(docs.schema[key].dataType)
    dealing = f"batch long, k array<{kind}>, words binary, codes binary, sizes binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 33
        for texts, ids in pieces(batches):
            s = sequence(texts, order)
            yield pa.record_batch([pa.array([batch], pa.int64()), pa.array([ids], pa.list_(own_type)), pa.array([pack(s.words, ordered=True)], pa.binary()),
                                   pa.array([pack(s.codes)], pa.binary()), pa.array([pack(s.sizes)], pa.binary())],
                                  names=["batch", "k", "words", "codes", "sizes"])
            batch += 1

    def read(row: dict) -> Sequence:
        return Sequence(unpack(row["words"], np.uint64, ordered=True), unpack(row["codes"], np.uint32), unpack(row["sizes"], np.int64), order)

    # texts are read once and do not move; bucketed, so that answers come to their batch
    dealt = bucketed(docs.select(text_or_empty(text).cast("binary").alias("raw"), F.col(key).alias("k")).mapInArrow(deal, dealing),
                     "batch", "batches", dealt=True)
    asking = "bucket int, batch long, level int, keys binary, of binary, weight binary"
    request, reply = _arrow(asking), _arrow("batch long, level int, bucket int, c binary, hit binary, more binary, weight binary")

    def asking_for(part: int):
        def ask(table: pa.Table) -> pa.Table:
            batch, = table.to_pylist()
            return _table([(k, batch["batch"], g.n, pack(g.key[x], ordered=True), None, None)
                           for g in read(batch).grams(buckets) for k, x in g.sorted_runs(buckets) if k % ROUNDS == part], request)
        return ask

    def look_up(requests: pa.Table, grams: pa.Table) -> pa.Table:
        """Per request: the counts of its keys, which of them are histories (bits), and what those are divided by and weigh."""
        rows, known, weights, out = requests.to_pylist(), _held(grams, range(1, order + 1)), {}, []
        for level in range(1, order + 1):
            own = [r for r in rows if r["batch"] < 0 and r["level"] == level]
            keys = _joined((r["keys"] for r in own), np.uint64, ordered=True)
            of, weight = _joined((r["of"] for r in own), np.int64), _joined((r["weight"] for r in own), np.float64)
            by = np.argsort(keys)
            weights[level] = keys[by], of[by], weight[by]
        for r in rows:
            if r["batch"] < 0:
                continue
            keys = unpack(r["keys"], np.uint64, ordered=True)
            (have, _, _, c), (histories, of, weight) = known[r["level"]], weights[r["level"]]
            at, there = _places(have, keys)
            count = np.zeros(len(keys), np.int64)
            count[there] = c[at[there]]
            at, hit = _places(histories, keys)
            out.append((r["batch"], r["level"], r["bucket"], pack(count), pack(hit), pack(of[at[hit]] - count[hit]), pack(weight[at[hit]])))
        return _table(out, reply)

    def answered(part: int) -> DataFrame:
        weights, grams = (x.where(F.col("bucket") % ROUNDS == part) for x in (model.weights, model.table))
        requests = dealt.groupBy("batch").applyInArrow(asking_for(part), asking).unionByName(weights.withColumn("batch", F.lit(-1).cast("long")))
        return saved(requests.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(
            look_up, "batch long, level int, bucket int, c binary, hit binary, more binary, weight binary"), "answers")

    answers = answered(0)
    for part in range(1, ROUNDS):
        answers = answers.unionByName(answered(part))

    def answer(table: pa.Table, answers: pa.Table) -> pa.Table:
        batch, = table.to_pylist()
        s, replies = read(batch), sorted(answers.to_pylist(), key=lambda r: (r["level"], r["bucket"]))
        log = base = hit = weight = of = None
        for g in s.grams(buckets, every=True):
            own = [r for r in replies if r["level"] == g.n]
            by = np.concatenate([x for _, x in g.sorted_runs(buckets)])
            count = np.empty(len(by), np.int64)
            count[by] = _joined((r["c"] for r in own), np.int64)
            c = count[g.mine]
            known = c > 0
            if g.n == 1:
                log = np.full(len(c), unknown)
                log[known] = np.log10(discounted(c[known], by_level[1]) * scale / max(tokens, 1))
                base, hit = np.log10((c + 1) / (tokens + types + 1)), known
            else:
                log += weight[g.before]
                log[known] = np.log10(discounted(c[known], by_level[g.n]) / of[g.before[known]])
            if g.n < order:
                histories = by[_joined((r["hit"] for r in own), bool)]
                weight, of = np.zeros(len(by)), count
                weight[histories] = _joined((r["weight"] for r in own), np.float64)
                of[histories] += _joined((r["more"] for r in own), np.int64)
        doc, m = s.doc, len(s.sizes)
        return pa.table([pa.array(batch["k"], own_type), pa.array(s.sizes), pa.array(np.bincount(doc, hit, m).astype(np.int64)),
                         pa.array(np.bincount(doc, base, m)), pa.array(np.bincount(doc, log, m))], schema=out_schema)

    out_schema = pa.schema([("k", own_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("base_score", pa.float64()), ("score", pa.float64())])
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        answer, f"k {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumnRenamed("k", key)
