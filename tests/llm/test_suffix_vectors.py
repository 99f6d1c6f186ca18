"""Steps of the suffix sort that take many texts at once, each against one text or string at a time."""

import random

import numpy as np

from loam.llm import suffix_dedup as sd


def test_anchors_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.choices(b"abc", k=k)) for k in (300, 0, 49, 50, 51, 700, 3, 120)] + [b"a" * 200, bytes(range(256))]
    for chunk in (137, 1 << 17):
        monkeypatch.setattr(sd, "CHUNK", chunk)
        text, *parts = sd.anchors_of(b"".join(texts), np.array([len(t) for t in texts]), 50, 20)
        for k, t in enumerate(texts):
            assert [x[text == k].tolist() for x in parts] == [x.tolist() for x in sd.anchors(t, 50, 20)]
    assert all(len(x) == 0 for x in sd.anchors_of(b"ab", np.array([1, 1]), 50, 20))


def test_prefixes_with_zero_bytes_and_block_borders(monkeypatch):
    rng = random.Random(8)
    strings = sorted({bytes(rng.choices(b"\0\1", k=rng.randint(0, 9))) for _ in range(400)})

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [0] + [common(a, b) for a, b in zip(strings, strings[1:])]
    for block in (1, 7, 1 << 12):
        monkeypatch.setattr(sd, "BLOCK", block)
        assert sd.prefixes(strings) == want
    assert sd.prefixes([]) == [] and sd.prefixes([b""]) == [0]


def test_merged_spans_of_many_rows():
    rng = random.Random(9)
    sizes = np.array([40, 0, 25, 40])
    spans = [(r, a, min(a + rng.randint(1, 9), int(sizes[r]))) for r in (0, 2, 3) for a in rng.choices(range(int(sizes[r])), k=6)]
    spans += [(2, 20, 25), (3, 0, 4)]  # one ends where its row does, the next row's begins at 0
    covered = {(r, i) for r, a, b in spans for i in range(a, b)}
    touching = {(r, b) for r, _, b in spans}
    row, start, end = sd.merged_spans(*(np.array(x) for x in zip(*spans)), sizes)
    assert {(r, i) for r, a, b in zip(row, start, end) for i in range(a, b)} == covered
    assert all((r, b) not in covered for r, b in zip(row, end)) and all((r, a - 1) not in covered for r, a in zip(row, start))
    assert all((r, b) in touching for r, b in zip(row, end)) and list(zip(row, start)) == sorted(zip(row, start))
