"""Suffix-array dedup: bytes of strings that an earlier document holds are removed."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U, byte_values, ranges, rising, starts_of
from .repeats import Chunk, Spec, find_repeats


class Prefixes:
    """Prefix polynomial hashes of a text, and comparisons of its suffixes by them."""

    def __init__(self, text: np.ndarray):
        pw = rising(len(text) + 1)
        self.total = np.zeros(len(text) + 1, U)
        np.cumsum(byte_values()[text] * pw[:-1], out=self.total[1:])
        self.text, self.lift = text, pw[::-1]  # hashes are compared at the text's end

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether so many bytes at a and b have equal hashes."""
        return (self.total[a + size] - self.total[a]) * self.lift[a] == (self.total[b + size] - self.total[b]) * self.lift[b]

    def common(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at a and b, up to depth, by binary search over hashes of prefixes; depth itself
        is tried first, as most of what is compared is equal."""
        low = np.where(self.same(a, b, depth), depth, 0)
        todo = np.flatnonzero(low < depth)
        a, b, lo, hi = a[todo], b[todo], low[todo], depth[todo] - 1
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.same(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[todo] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a is less than, equal to or greater than that at b, up to depth."""
        at = self.common(a, b, depth)
        done = at >= depth
        at = np.minimum(at, depth - 1)
        return np.where(done, 0, np.sign(self.text[a + at].astype(np.int64) - self.text[b + at]))


def suffix_sort(hashes: Prefixes, first: np.ndarray, segment: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes in each segment (segments lie together) by a bottom-up mergesort of all segments at once. Each round
    places every suffix of a block by binary search in its neighbour, with hash comparisons up to depth, which is the same
    within a segment. Suffixes that agree up to depth become one, so a block holds different ones only. Returns those that
    stay, in order, and for each suffix the one that stands for it."""
    owner = np.arange(len(first))
    items, block = owner.copy(), owner - np.flatnonzero(starts_of(segment))[np.cumsum(starts_of(segment)) - 1] if len(first) else owner
    while True:
        seg = segment[items]
        new = starts_of(seg, block)
        start = np.flatnonzero(new)
        mine = np.cumsum(new) - 1
        size = np.diff(np.append(start, len(items)))
        # each block's neighbour, if it has one
        bseg, bnum = seg[start], block[start]
        left = np.zeros(len(start), bool)
        left[:-1] = (bseg[1:] == bseg[:-1]) & (bnum[:-1] % 2 == 0) & (bnum[1:] == bnum[:-1] + 1)
        if not left.any():
            if not (block > 0).any():
                return items, owner
            block = block >> 1
            continue
        right = np.zeros(len(start), bool)
        right[1:] = left[:-1]
        other = np.arange(len(start)) + left - right
        o = other[mine]
        lo = np.where(o == mine, 0, start[o])
        hi = np.where(o == mine, 0, start[o] + size[o])
        base = lo.copy()
        equal = np.full(len(items), -1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            m = (lo[todo] + hi[todo]) >> 1
            own = items[todo]
            c = hashes.less(first[items[m]], first[own], depth[own])
            lo[todo] = np.where(c < 0, m + 1, np.where(c == 0, m, lo[todo]))
            hi[todo] = np.where(c < 0, hi[todo], m)
            equal[todo[c == 0]] = m[c == 0]
            todo = todo[lo[todo] < hi[todo]]
        gone = (equal >= 0) & right[mine]
        owner[items[gone]] = items[equal[gone]]
        # place among what stays: own rank, and what is less in the other block
        stays = np.concatenate([[0], np.cumsum(~gone)])
        rank = stays[np.arange(len(items))] - stays[start[mine]] + stays[lo] - stays[base]
        keep = np.flatnonzero(~gone)
        pair = starts_of(seg[keep], block[keep] >> 1)
        at = np.flatnonzero(pair)[np.cumsum(pair) - 1] + rank[keep]
        items[at], block[at] = items[keep], block[keep] >> 1
        items, block = items[: len(keep)], block[: len(keep)]


def equal_windows(text: np.ndarray, first: np.ndarray, segment: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Numbers the strings of depth bytes at first by sorting them as suffixes; those that sorting has made one are equal.
    Every such finding is verified byte by byte; in a segment with a hash collision, bytes decide."""
    _, owner = suffix_sort(Prefixes(text), first, segment, depth)
    while (owner[owner] != owner).any():
        owner = owner[owner]
    same = np.flatnonzero(owner != np.arange(len(owner)))
    false = []
    for i in range(0, len(same), 1 << 14):
        s = same[i : i + (1 << 14)]
        n = depth[s]
        off = text[ranges(first[s], n)] != text[ranges(first[owner[s]], n)]
        false.append(s[np.logical_or.reduceat(off, np.cumsum(n) - n)])
    false = np.concatenate(false) if false else same
    for s in np.unique(segment[false]).tolist():
        known: dict = {}
        for i in np.flatnonzero(segment == s).tolist():
            owner[i] = known.setdefault(text[first[i] : first[i] + depth[i]].tobytes(), i)
    return np.unique(owner, return_inverse=True)[1]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, span_starts array<long>, span_lengths array<long>, kept binary, text_hash long"


def _finish(chunk: Chunk, first: np.ndarray, end: np.ndarray) -> pa.Table:
    out = []
    a, b = np.searchsorted(first, chunk.start).tolist(), np.searchsorted(first, chunk.end).tolist()
    ids = chunk.table["doc_id"].to_pylist()
    for i, (lo, hi) in enumerate(zip(chunk.start.tolist(), chunk.end.tolist())):
        s, e = first[a[i] : b[i]].tolist(), end[a[i] : b[i]].tolist()
        cut = [lo, *(x for pair in zip(s, e) for x in pair), hi]
        kept = b"".join(chunk.data[x:y].tobytes() for x, y in zip(cut[::2], cut[1::2]))
        out.append((ids[i], hi - lo, hi - lo - len(kept), len(s), [x - lo for x in s], [y - x for x, y in zip(s, e)], kept))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
    return pa.Table.from_arrays([*columns, chunk.table["text_hash"]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, sampled: int = 32, chunk_bytes: int = 1 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """For each row: its id, bytes, removed bytes, removed spans, the bytes that stay, and a hash of the text.

    A byte is removed if a string of window bytes covers it that also starts in a row with a smaller id. Null texts are
    empty; texts shorter than a window keep all; a null id counts as larger than any other; rows with the same id are one
    document's copies and don't remove each other. Other columns are ignored. sampled: windows that share an anchor at
    most (63 or fewer); it changes the work, not the result.
    """
    spec = partial(Spec, window - sampled + 1, sampled, False, True)
    return find_repeats(docs, id_col, text_col, spec, equal_windows, _finish, SCHEMA, chunk_bytes, bucket_bytes)
