"""Anchors and runs."""

import numpy as np

from textmend.llm.arrays import byte_values
from textmend.llm.repeats import find_runs


def runs_of(text: bytes, k: int, w: int, block: int = 1 << 16) -> dict:
    data = np.frombuffer(text, np.uint8)
    return find_runs(lambda a, b: byte_values()[data[a:b]], len(data), np.array([0]), np.array([len(data)]), k, w, block)


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(1)
    for size in (0, 5, 12, 13, 400, 1000):
        text = bytes(rng.integers(97, 101, size).astype(np.uint8))
        for block in (64, 1 << 16):
            r = runs_of(text, 7, 6, block)
            windows = [j for a, n in zip(r["js"].tolist(), r["nwin"].tolist()) for j in range(a, a + n)]
            assert windows == list(range(max(0, size - 11)))
            assert all(0 <= o - n + 1 and o < 6 for o, n in zip(r["off"].tolist(), r["nwin"].tolist()))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    part = bytes(rng.integers(97, 123, 40).astype(np.uint8))
    a, b = (bytes(rng.integers(97, 123, n).astype(np.uint8)) + part + bytes(rng.integers(97, 123, 9).astype(np.uint8)) for n in (3, 17))
    found = []
    for text, at in ((a, 3), (b, 17)):
        r = runs_of(text, 7, 6)
        found.append({j - at: (int(key), int(o - (j - s))) for s, n, o, key in zip(r["js"], r["nwin"], r["off"], r["key"]) for j in range(s, s + n)})
    assert all(found[0][j] == found[1][j] for j in range(40 - 11))


def test_anchor_hashes_are_spread_evenly():
    rng = np.random.default_rng(3)
    r = runs_of(bytes(rng.integers(97, 123, 200_000).astype(np.uint8)), 27, 24)
    counts = np.bincount((r["key"] * np.uint64(8) >> np.uint64(48)).astype(int), minlength=8)
    assert counts.max() < 1.2 * counts.min()
