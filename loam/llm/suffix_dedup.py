"""Removal of repeated byte strings by a distributed suffix sort.

A byte is removed if a ``LENGTH``-byte string that covers it also starts somewhere else.
Sorting every suffix would cost a hundred times the corpus; sorting sampled ones is
enough to decide all of them exactly:

1. anchors: of the ``SPREAD`` places where a string's first bytes may lie, the one whose
   8 bytes hash lowest.  Equal strings have their anchor at the same offset, and what
   stands behind it for ``LENGTH - SPREAD + 1`` bytes is equal too, so only anchors whose
   such piece occurs twice (by hash count) take part;
2. suffixes at these anchors, ``LENGTH + SPREAD`` bytes deep, are sorted by a merge sort:
   every task sorts its own run of distinct suffixes and sends it front-coded (length of
   the prefix shared with the suffix before, then the rest) cut at splitters; for each
   range the runs are merged, and neighbours are compared as rows of a byte matrix for
   the prefix that they share;
3. an anchor that shares ``LENGTH`` or more bytes with a neighbour covers those bytes;
4. strings that start before the first anchor of a repeat are left: their digests
   (95 bits) are counted, for the few places where step 3 leaves the answer open.

Scale: texts are joined by row number to what concerns them, never gathered.  Equal
suffixes of one run are one entry, so a suffix that a third of all rows share is sent
once per run; splitters come from a sample, and a guard entry on either side of a cut
keeps neighbours known across ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import bucketed, dropped, pack, saved, shuffle_parts, text_or_empty, unpack

LENGTH = 200
SPREAD = 100
#: Windows whose anchors are found at once; bounds a worker's arrays.
CHUNK = 1 << 17
#: Suffixes that a task sorts as one run.
RUN = 150_000
#: Neighbours that are compared at once.
BLOCK = 1 << 12
#: Entries that one range should get.
RANGE = 100_000
#: Sampled suffixes per range that the splitters come from.
SAMPLE = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _lowest(raw: bytes, at: int, count: int, spread: int) -> np.ndarray:
    """For each of ``count`` starts from ``at`` on, the place of the next ``spread`` whose 8 bytes hash lowest."""
    places = min(count + spread, len(raw) - at - 7)
    mixed = np.ndarray((places,), "<u8", raw, at, (1,)).astype(np.uint64)  # the 8 bytes at every place
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    low = (mixed & ~_LOW) | np.arange(places, dtype=np.uint64)  # equal hashes: the first place
    span = 1
    while 2 * span <= spread:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if spread > span:
        low = np.minimum(low[: span - spread], low[spread - span:])
    return (low[:count] & _LOW).astype(np.int64) + at


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each of ``first`` on, one range behind the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def anchors_of(raw: bytes, sizes: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first, last): ``anchors`` of each of several texts, which stand one behind the other in ``raw``."""
    begin, strings = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    if not strings.any():
        return (np.empty(0, np.int64),) * 4
    text, start = np.repeat(np.arange(len(sizes)), strings), _ranges(begin, strings)
    windows = len(raw) - length + 1
    place = np.concatenate([_lowest(raw, at, min(CHUNK, windows - at), spread) for at in range(0, windows, CHUNK)])[start]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(start)) - 1
    text = text[first]
    return text, place[first] - begin[text], start[first] - begin[text], start[last] - begin[text]


def anchors(raw: bytes, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): every anchor and the first and last start of a string that has it."""
    strings = len(raw) - length + 1
    if strings <= 0:
        return (np.empty(0, np.int64),) * 3
    found = [_lowest(raw, at, min(CHUNK, strings - at), spread) for at in range(0, strings, CHUNK)]
    place = np.concatenate(found)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[first], first, np.append(first[1:], strings) - 1


def _anchor_table(texts: DataFrame, length: int, spread: int) -> DataFrame:
    """row, place, first, last, piece (hash of what equal strings share behind the anchor)."""
    known = length - spread + 1

    def found(rows: list[int], raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(raws) == 1:
            raw, parts = raws[0], anchors(raws[0], length, spread)
            parts = (np.zeros(len(parts[0]), np.int64), *parts)
        else:
            raw = b"".join(raws)
            parts = anchors_of(raw, np.array([len(r) for r in raws], np.int64), length, spread)
        text, place, first, last = parts
        if len(place):
            begin = np.cumsum([0, *map(len, raws[:-1])])
            digest = xxhash.xxh64_digest
            piece = np.frombuffer(b"".join([digest(raw[p: p + known]) for p in (place + begin[text]).tolist()]), ">u8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(rows, np.int64)[text]), *[pa.array(x.astype(np.int32)) for x in (place, first, last)],
                 pa.array(piece.astype(np.uint64).view(np.int64))], ["row", "place", "first", "last", "piece"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, raws, size = [], [], 0
            for row, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if raws and size + len(raw) > CHUNK:  # short texts together, a long one by itself
                    yield from found(rows, raws)
                    rows, raws, size = [], [], 0
                rows.append(row)
                raws.append(raw)
                size += len(raw)
            if raws:
                yield from found(rows, raws)

    return texts.select("row", "raw").mapInArrow(
        find, "row long, place int, first int, last int, piece long")


# --- merge sort of front-coded runs ---------------------------------------------------------------------------------

def _prefixes(ordered: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, ordered), np.int64, len(ordered))
    width = max(int(sizes.max(initial=0)), 1)
    out = np.zeros(len(ordered), np.int64)
    for at in range(0, len(ordered) - 1, BLOCK):
        some = ordered[at: at + BLOCK + 1]
        flat = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in some]), np.uint8).reshape(len(some), width)
        differ = flat[1:] != flat[:-1]
        first = differ.argmax(1)
        first[~differ[np.arange(len(first)), first]] = width
        out[at + 1: at + len(some)] = np.minimum(first, np.minimum(sizes[at: at + len(first)], sizes[at + 1: at + len(some)]))
    return out


def prefixes(ordered: list[bytes]) -> list[int]:
    """Length of the prefix that each of the sorted strings shares with the one before (0 for the first)."""
    return _prefixes(ordered).tolist()


def front_code(ordered: list[bytes], shared: list[int]) -> tuple[bytes, bytes]:
    """(numbers, rest): shared prefix and rest lengths as uint16 pairs, and the rests; both compressed."""
    shared = [0, *shared[1:]]
    rest = [s[k:] for s, k in zip(ordered, shared)]
    numbers = np.array([shared, [len(r) for r in rest]], np.uint16).tobytes()
    pack = zstandard.ZstdCompressor(level=1)
    return pack.compress(numbers), pack.compress(b"".join(rest))


def front_decode(numbers: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    unpack = zstandard.ZstdDecompressor()
    shared, sizes = np.frombuffer(unpack.decompress(numbers), np.uint16).reshape(2, -1).tolist()
    body, at, last, out = unpack.decompress(rest), 0, b"", []
    for k, n in zip(shared, sizes):
        last = last[:k] + body[at: at + n]
        at += n
        out.append(last)
    return out, shared


def _merged(runs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs' suffixes (counted through the runs) in order, and the prefix that each shares with the one before.

    Python's sort finds runs that are in order and merges them; equal suffixes stay in the order of their runs.
    """
    strings = [s for r in runs for s in r]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return np.array(order, np.int64), _prefixes([strings[i] for i in order])


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, shared prefix with the suffix put out before) of all runs' suffixes in order."""
    order, shared = _merged([r[0] for r in runs])
    sizes = np.array([len(r[0]) for r in runs], np.int64)
    run, index = np.repeat(np.arange(len(runs)), sizes), _ranges(np.zeros(len(runs), np.int64), sizes)
    return zip(run[order].tolist(), index[order].tolist(), shared.tolist())


_BLOB = ("bucket int, run string, numbers binary, rest binary, twice binary, guards int, "
         "row array<long>, place array<int>, first array<int>, last array<int>, piece array<long>, shared array<int>")
_SORTED = "row long, place int, first int, last int, piece long, shared int"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
_FIELDS = ["row", "place", "first", "last", "piece"]


def _runs(jobs: DataFrame, depth: int, splitters: list[bytes], run_size: int) -> DataFrame:
    """Front-coded pieces of sorted runs, one row for each run and range.

    jobs: row, raw, and arrays place, first, last, piece.  Suffixes that a run holds twice
    have their answer (the whole depth) at once: their places are sent along without bytes,
    and one entry marked ``twice`` stands for them in the sort.
    """
    shared_cuts = jobs.sparkSession.sparkContext.broadcast(splitters)

    def flush(strings: list[bytes], held: list[tuple[np.ndarray, ...]], run: str, cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(strings)), key=strings.__getitem__)
        strings = [strings[i] for i in order]
        members = [np.concatenate(x)[order] for x in zip(*held)]
        shared, sizes = _prefixes(strings), np.fromiter(map(len, strings), np.int64, len(strings))
        new = np.append(True, (shared[1:] < sizes[1:]) | (sizes[1:] != sizes[:-1]))
        start = np.flatnonzero(new)
        twice = np.diff(np.append(start, len(strings))) > 1
        rows = []
        several = np.flatnonzero(twice[np.cumsum(new) - 1])
        for k in range(0, len(several), 4096):  # answers known here, spread over the ranges
            at = several[k: k + 4096]
            bucket = xxhash.xxh32_intdigest(f"{run}{k}") % (len(cuts) + 1)
            rows.append((bucket, run, None, None, None, 0, *[m[at] for m in members], sizes[at].astype(np.int32)))
        ordered, shared = [strings[i] for i in start.tolist()], shared[start].tolist()
        own = [np.where(twice, -1, m[start]).astype(m.dtype) for m in members]
        bounds = [0]
        for c in cuts:
            bounds.append(bisect_right(ordered, c, bounds[-1]))
        bounds.append(len(ordered))
        for bucket, (a, b) in enumerate(zip(bounds, bounds[1:])):
            lo, hi = max(a - 1, 0), min(b + 1, len(ordered))  # with the neighbours beyond the cuts
            if lo == hi:
                continue
            numbers, rest = front_code(ordered[lo:hi], shared[lo:hi])
            rows.append((bucket, run, numbers, rest, np.packbits(twice[lo:hi]).tobytes(), 2 * (lo < a) + (hi > b),
                         *[m[a:b] for m in own], np.empty(0, np.int32)))
        for k in range(0, len(rows), 64):
            part = list(zip(*rows[k: k + 64]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.int32()), pa.array(part[1], pa.string()), *[pa.array(x, pa.binary()) for x in part[2:5]],
                 pa.array(part[5], pa.int32()), *[pa.array(x, pa.list_(t)) for x, t in zip(part[6:], _KINDS)]],
                ["bucket", "run", "numbers", "rest", "twice", "guards", *_FIELDS, "shared"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared_cuts.value
        strings: list[bytes] = []
        held: list[tuple[np.ndarray, ...]] = []
        n, task = 0, TaskContext.get().partitionId()
        for b in batches:
            for row, raw, *lists in zip(b.column(0).to_pylist(), b.column(1), *[b.column(k) for k in range(2, 6)]):
                raw = raw.as_py()
                lists = [x.values.to_numpy(zero_copy_only=False) for x in lists]
                at = 0
                while at < len(lists[0]):
                    z = min(len(lists[0]), at + run_size - len(strings))
                    strings += [raw[p: p + depth] for p in lists[0][at:z].tolist()]
                    held.append((np.full(z - at, row, np.int64), *[x[at:z] for x in lists]))
                    at = z
                    if len(strings) >= run_size:
                        yield from flush(strings, held, f"{task}-{n}", cuts)
                        strings, held, n = [], [], n + 1
        if strings:
            yield from flush(strings, held, f"{task}-{n}", cuts)

    return jobs.mapInArrow(sort, _BLOB)


def _merge_ranges(blobs: DataFrame) -> DataFrame:
    """row, place, first, last, piece, shared: the longest prefix that the suffix shares with any other."""
    def merged(table: pa.Table) -> pa.Table:
        runs, who, members, answers, n = [], [], [], [], 0
        for numbers, rest, twice, guards, *lists in zip(*[table[c] for c in ("numbers", "rest", "twice", "guards", *_FIELDS, "shared")]):
            lists = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            if not numbers.is_valid:
                answers.append(lists)
                continue
            strings = front_decode(numbers.as_py(), rest.as_py())[0]
            runs.append(strings)
            own = np.full(len(strings), -1, np.int64)  # the neighbours beyond the cuts belong to other ranges
            own[guards.as_py() >> 1:][: len(lists[0])] = np.arange(n, n + len(lists[0]))
            own[np.unpackbits(np.frombuffer(twice.as_py(), np.uint8))[: len(strings)] == 1] = -1  # their places are answered already
            who.append(own)
            members.append(lists[:-1])
            n += len(lists[0])
        if runs:
            order, shared = _merged(runs)
            own = np.concatenate(who)[order]
            shared = np.maximum(shared, np.append(shared[1:], 0))  # with the one before or behind
            own, shared = own[own >= 0], shared[own >= 0]
            answers.append([*[np.concatenate(x)[own] for x in zip(*members)], shared])
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(zip(*answers), _KINDS)], names=[*_FIELDS, "shared"])

    return blobs.groupBy("bucket").applyInArrow(merged, _SORTED)


def sorted_prefixes(texts: DataFrame, chosen: DataFrame, depth: int, n: int, run_size: int, range_size: int) -> DataFrame:
    """``chosen`` (row, place, first, last, piece) with ``shared`` (at most ``depth``)."""
    ranges = max(1, -(-n // range_size), min(shuffle_parts(texts.sparkSession), n // 2000))
    splitters: list[bytes] = []
    if ranges > 1:
        modulus = max(1, n // (SAMPLE * ranges))
        drawn = chosen.where(F.pmod(F.xxhash64("row", "place"), F.lit(modulus)) == 0).select("row", "place")
        heads = texts.select("row", "raw").join(drawn, "row").select(
            F.substring("raw", (F.col("place") + 1).cast("int"), F.lit(depth)).alias("s"))
        sample = sorted(bytes(r["s"]) for r in heads.collect())  # about SAMPLE per range
        splitters = sorted(set(sample[SAMPLE - 1:: SAMPLE]))
    jobs = chosen.groupBy("row").agg(F.collect_list(F.struct("place", "first", "last", "piece")).alias("m"))
    jobs = texts.select("row", "raw").join(jobs, "row").select(
        "row", "raw", *[F.col(f"m.{c}").alias(c) for c in _FIELDS[1:]])
    blobs = _runs(jobs, depth, splitters, run_size)
    return _merge_ranges(blobs.repartition(len(splitters) + 1, "bucket") if splitters else blobs)


# --- strings before the first anchor of a repeat -----------------------------------------------------------------

def open_ranges(place: np.ndarray, first: np.ndarray, last: np.ndarray, shared: np.ndarray,
                length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest open start among each anchor's own strings (lo > hi: none), for one text.

    Anchors in the order of their places.  An anchor's shared prefix settles the strings that
    lie within it; a string can repeat only if it ends within its own anchor's prefix.
    """
    base = int(min(first.min(), place.min()))
    edges = np.zeros((2, int(max(last.max(), place.max())) - base + 2), np.int64)
    for row, a, b in ((0, first, np.minimum(np.minimum(last, place - 1), place + shared - length)),
                      (1, place, np.minimum(place + shared - length, last.max()))):
        real = a <= b
        np.add.at(edges[row], a[real] - base, 1)
        np.add.at(edges[row], b[real] - base + 1, -1)
    able, settled = np.cumsum(edges, axis=1) > 0
    still = np.append(np.flatnonzero(able & ~settled) + base, (1 << 31) - 1)
    lo = still[np.searchsorted(still, first)]
    hi = np.append(-1, still)[np.searchsorted(still, last, side="right")]
    return lo, hi


def _open_ranges(found: DataFrame, length: int) -> DataFrame:
    """``found`` with lo and hi of each anchor."""
    per_row = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS[1:], "shared"))).alias("m")) \
        .select("row", *[F.col(f"m.{c}").alias(c) for c in (*_FIELDS[1:], "shared")])

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t.to_pandas_dtype())) for x, t in zip(zip(*held), [*_KINDS, *[pa.int32()] * 2])],
                                          [*_FIELDS, "shared", "lo", "hi"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for row, *lists in zip(b.column(0).to_pylist(), *[b.column(k) for k in range(1, 6)]):
                place, first, last, piece, shared = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                held.append((np.full(len(place), row, np.int64), place, first, last, piece, shared,
                             *open_ranges(place, first, last, shared, length)))
                size += len(place)
                if size >= 1 << 16:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    return per_row.mapInArrow(mark, _SORTED + ", lo int, hi int")


def _open_strings(texts: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """(row, place) of strings that start before an anchor and occur elsewhere.

    marked: the result of ``_open_ranges``.  All strings that have their anchor at
    such an offset from an equal piece as an open one are counted by digest.
    """
    need = marked.where("lo <= hi").groupBy("piece").agg(
        F.min(F.col("place") - F.col("hi")).alias("least"), F.max(F.col("place") - F.col("lo")).alias("most"))
    counted = marked.join(need, "piece") \
        .withColumn("from", F.greatest("first", F.col("place") - F.col("most"))) \
        .withColumn("to", F.least("last", F.col("place") - F.col("least"), F.col("place") + F.col("shared") - length)) \
        .where("from <= to")
    jobs = counted.groupBy("row").agg(F.collect_list(F.struct("from", "to", "lo", "hi")).alias("m"))
    jobs = texts.select("row", "raw").join(jobs, "row").select(
        "row", "raw", *[F.col(f"m.{c}").alias(c) for c in ("from", "to", "lo", "hi")])

    buckets = 2 * shuffle_parts(texts.sparkSession)
    kinds = [pa.int32(), *[pa.binary()] * 6]
    names = ["bucket", "h1", "h2", "n", "asks", "row", "place"]

    def digest_order(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the digests, and which in that order differ from the one before."""
        order = np.argsort(h1)
        apart, rest = np.diff(h1[order]) != 0, np.diff(h2[order]) != 0
        if (rest & ~apart).any():  # the second halves matter only where first ones are equal
            order = np.lexsort((h2, h1))
            apart, rest = np.diff(h1[order]) != 0, np.diff(h2[order]) != 0
        return order, np.append(True, apart | rest)

    def flush(held: list[tuple[bytes, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Each digest once, by bucket, with its count (2: several); open places with a single digest go
        along, and those that this flush answers itself come without digests."""
        whole = np.frombuffer(b"".join(h[0] for h in held), ">u8").reshape(-1, 2).astype(np.uint64)
        h1, h2 = whole[:, 0], (whole[:, 1] >> np.uint64(33)).astype(np.uint32)
        rows = np.concatenate([np.full(len(h[2]), h[1], np.int64) for h in held])
        places, is_open = np.concatenate([h[2] for h in held]).astype(np.int32), np.concatenate([h[3] for h in held])
        order, new = digest_order(h1, h2)
        h1, h2, rows, places, is_open = (x[order] for x in (h1, h2, rows, places, is_open))
        own = ((h1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)  # ranges of digests, in their order
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h1)))
        answered = is_open & (count > 1)[np.cumsum(new) - 1]
        asks = is_open[start] & (count == 1)
        edges = np.searchsorted(own[start], np.arange(buckets + 1))
        out = []
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            if a < z:
                at = start[a:z]
                ask = at[asks[a:z]]
                out.append((k, pack(h1[at], ordered=True), pack(h2[at]), pack(np.minimum(count[a:z], 2).astype(np.uint8)),
                            pack(asks[a:z]), pack(rows[ask]), pack(places[ask])))
        done = np.flatnonzero(answered)
        for at in range(0, len(done), 1 << 16):  # dealt over the buckets
            some = done[at: at + (1 << 16)]
            out.append((int(own[some[0]]), None, None, None, None, pack(rows[some]), pack(places[some])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, np.ndarray, np.ndarray]] = []
        size = 0
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for row, raw, *lists in zip(b.column(0).to_pylist(), b.column(1), *[b.column(k) for k in range(2, 6)]):
                raw = raw.as_py()
                first, last, lo, hi = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                count = last - first + 1
                many = np.cumsum(count)
                at = 0
                while at < len(first):
                    z = max(at + 1, int(np.searchsorted(many, many[at] - count[at] + (1 << 18), "right")))
                    part, places = slice(at, z), _ranges(first[at:z], count[at:z])
                    held.append((b"".join([digest(raw[p: p + length]) for p in places.tolist()]), row, places,
                                 (places >= np.repeat(lo[part], count[part])) & (places <= np.repeat(hi[part], count[part]))))
                    size += len(places)
                    at = z
                    if size >= 1 << 20:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    def resolve(table: pa.Table) -> pa.Table:
        """Open places whose digest several flushes hold, and those answered before."""
        given = table.to_pylist()
        done = [r for r in given if r["h1"] is None]
        given = [r for r in given if r["h1"] is not None]
        rows = [unpack(r["row"], np.int64) for r in done]
        places = [unpack(r["place"], np.int32) for r in done]
        if given:
            h1 = np.concatenate([unpack(r["h1"], np.uint64, ordered=True) for r in given])
            h2 = np.concatenate([unpack(r["h2"], np.uint32) for r in given])
            n = np.concatenate([unpack(r["n"], np.uint8) for r in given]).astype(np.int64)
            asks = np.concatenate([unpack(r["asks"], bool) for r in given])
            where = np.zeros((2, len(h1)), np.int64)
            where[0, asks] = np.concatenate([unpack(r["row"], np.int64) for r in given])
            where[1, asks] = np.concatenate([unpack(r["place"], np.int32) for r in given])
            order, new = digest_order(h1, h2)
            total = np.add.reduceat(n[order], np.flatnonzero(new))
            again = order[(total >= 2)[np.cumsum(new) - 1] & asks[order]]
            rows.append(where[0, again])
            places.append(where[1, again].astype(np.int32))
        return pa.table([pa.array(np.concatenate(rows)), pa.array(np.concatenate(places))], names=["row", "place"])

    rows = jobs.mapInArrow(digests, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))
    # a digest meets at most one entry of every flush here, however often it occurs
    return rows.groupBy("bucket").applyInArrow(resolve, "row long, place int")


def repeated_spans(texts: DataFrame, length: int = LENGTH, spread: int = SPREAD, run_size: int = RUN,
                   range_size: int = RANGE) -> DataFrame:
    """(row, spans): arrays of [start, end) byte ranges, not merged, of the rows that have any.

    texts: row (unique), raw (binary).
    """
    table = saved(_anchor_table(texts, length, spread), "anchors")
    twice = table.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece")
    chosen = saved(table.join(twice, "piece", "left_semi").select(*_FIELDS), "chosen")
    dropped(table)
    n = chosen.count()
    found = saved(sorted_prefixes(texts, chosen, length + spread, n, run_size, range_size), "prefixes")
    dropped(chosen)
    marked = saved(_open_ranges(found, length), "marked")
    dropped(found)
    starts = saved(_open_strings(texts, marked, length), "starts")
    spans = marked.where(F.col("shared") >= length).select("row", F.col("place").alias("a"), (F.col("place") + F.col("shared")).alias("b")) \
        .unionByName(starts.select("row", F.col("place").alias("a"), (F.col("place") + length).alias("b")))
    spans = saved(spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    dropped(marked)
    dropped(starts)
    return spans


def merged_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): maximal runs that the spans [a, b) of each row cover; ``sizes`` are the rows' lengths."""
    if not len(row):
        return (np.empty(0, np.int64),) * 3
    base = np.cumsum(sizes + 1) - (sizes + 1)  # one place between rows, so no run reaches over two
    order = np.argsort(a + base[row], kind="stable")
    row = row[order]
    low, reach = a[order] + base[row], np.maximum.accumulate(b[order] + base[row])
    first = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
    last = np.append(first[1:], len(row)) - 1
    row = row[first]
    return row, low[first] - base[row], reach[last] - base[row]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, spread: int = SPREAD,
                   run_size: int = RUN, range_size: int = RANGE) -> DataFrame:
    """One row per document: key, n_bytes, spans (array of start, end), kept (the bytes that stay).

    NULL text is empty; texts shorter than ``length`` keep everything; equal rows are
    different places, so their strings count as repeated.  Strings never cross documents.
    Memory: a worker holds one text, a run or one range's entries at a time.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                        text_or_empty(text).cast("binary").alias("raw"))
    texts = bucketed(texts, "row", "texts")  # three joins with what concerns each text follow
    spans = repeated_spans(texts, length, spread, run_size, range_size)

    def cut(raws: pa.Array, lists: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
        row, start, end = merged_spans(np.repeat(np.arange(len(raws)), counts), a, b,
                                       pc.binary_length(raws).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(raws))))
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        start, end, kept = start.tolist(), end.tolist(), []
        for raw, at, z in zip(raws, ends.tolist(), ends[1:].tolist()):
            raw = raw.as_py()
            kept.append(b"".join(raw[i:j] for i, j in zip([0, *end[at:z]], [*start[at:z], len(raw)])))
        return pa.StructArray.from_arrays([runs, pa.array(kept, pa.binary())], ["spans", "kept"])

    joined = texts.join(spans, "row", "left")
    result = F.arrow_udf(cut, "spans array<struct<start:long,end:long>>, kept binary")("raw", "spans")
    return joined.select(F.col("key").alias(key), F.length("raw").cast("long").alias("n_bytes"), result.alias("r")) \
        .select(key, "n_bytes", "r.spans", "r.kept")


def digests(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``."""
    return cut.select(key, "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
