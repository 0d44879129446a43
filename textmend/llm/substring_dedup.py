"""Substring dedup: words of passages that also start at another place are removed.

Suffixes are dealt to buckets by prefixes of variable length: the anchor's words (the k words that the suffix at an anchor
begins with), or a whole window's where an anchor is hot. In a bucket, prefix_groups lengthens them further until a group
fits, and the trees of all groups are grown together.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import ranges, starts_of
from .repeats import Chunk, Spec, find_repeats


def suffix_trees(symbols: np.ndarray, first: np.ndarray, prefix: np.ndarray, depth: np.ndarray) -> dict:
    """Suffix trees of the suffixes at first, one tree for each prefix group, built from the root down to depth.

    All trees grow together, a level at a time: the suffixes below a node are parted by their next symbol; where they
    part, new nodes begin, and suffixes that stay alone become leaves. depth is the same within a prefix group. Returns each
    suffix's deepest node, each node's depth and parent (-1 for a root), and the suffixes in nodes of full depth, which have
    that many symbols in common with another."""
    node = np.asarray(prefix, np.int64).copy()
    roots = int(node.max()) + 1 if len(node) else 0
    depths, parents = [np.zeros(roots, np.int64)], [np.full(roots, -1)]
    made = roots
    act = np.flatnonzero(np.bincount(node, minlength=roots)[node] > 1)
    deep = []
    for level in range(int(depth.max(initial=0)) + 1):
        full = depth[act] <= level
        deep.append(act[full])
        act = act[~full]
        if not len(act):
            break
        nxt = symbols[first[act] + level]
        by = np.lexsort((nxt, node[act]))
        act, nxt, above = act[by], nxt[by], node[act][by]
        new = starts_of(above, nxt)
        child = np.cumsum(new) - 1
        g0 = np.flatnonzero(new)
        size = np.diff(np.append(g0, len(act)))
        # a node whose suffixes all go on with the same symbol stays a node, only deeper: an edge of many symbols
        splits = np.bincount(above, minlength=made)[above[g0]] > size
        number = np.where(splits, made + np.cumsum(splits) - 1, above[g0])
        depths.append(np.full(int(splits.sum()), level + 1))
        parents.append(above[g0][splits])
        made += int(splits.sum())
        node[act] = number[child]
        act = act[(size > 1)[child]]
    out, act = np.concatenate(depths), np.concatenate([act[:0], *deep])
    out[node[act]] = depth[act]
    return {"node": node, "depth": out, "parent": np.concatenate(parents), "deep": act}


def prefix_groups(symbols: np.ndarray, first: np.ndarray, segment: np.ndarray, depth: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts the suffixes into groups of at most most, by prefixes as long as that takes; equal strings stay together."""
    todo, out = [(np.arange(len(first)), -1)], []
    while todo:
        rows, length = todo.pop()
        if len(rows) <= most or length >= int(depth[rows].min()):
            out.append(rows)
            continue
        by_symbol = segment[rows] if length < 0 else symbols[first[rows] + length]
        by = np.argsort(by_symbol, kind="stable")
        cut = np.flatnonzero(starts_of(by_symbol[by]))
        parts = np.split(rows[by], cut[1:])
        small: list = []
        for p in parts:  # short prefixes are taken together up to the size
            if len(p) > most:
                todo.append((p, length + 1))
            elif small and sum(map(len, small)) + len(p) > most:
                out.append(np.concatenate(small))
                small = [p]
            else:
                small.append(p)
        if small:
            out.append(np.concatenate(small))
    return out


def equal_windows(symbols: np.ndarray, first: np.ndarray, segment: np.ndarray, depth: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Numbers the strings of depth symbols: those below the same internal node of full depth alike, all others apart."""
    out, made = np.empty(len(first), np.int64), 0
    for rows in prefix_groups(symbols, first, segment, depth, most):
        _, prefix = np.unique(segment[rows], return_inverse=True)
        tree = suffix_trees(symbols, first[rows], prefix, depth[rows])
        number = np.arange(len(rows)) + len(tree["depth"])
        number[tree["deep"]] = tree["node"][tree["deep"]]
        out[rows] = number + made
        made += len(tree["depth"]) + len(rows)
    return np.unique(out, return_inverse=True)[1]


SCHEMA = "doc_id long, n_words long, n_removed long, span_starts array<long>, span_lengths array<long>, kept string, text_hash long"


def _finish(chunk: Chunk, first: np.ndarray, end: np.ndarray) -> pa.Table:
    gone = ranges(first, end - first)
    # a word goes with the white space after it, so what stays keeps its lines
    row = np.searchsorted(chunk.hi, gone, "right")
    upto = np.append(chunk.first, len(chunk.data))[gone + 1]
    cut = np.minimum(upto, chunk.end[row]) - chunk.first[gone]
    keep = np.ones(len(chunk.data), bool)
    keep[ranges(chunk.first[gone], cut)] = False
    raw = chunk.data[keep].tobytes()
    size = np.concatenate([[0], np.cumsum(keep)])
    kept = [raw[x:y] for x, y in zip(size[chunk.start].tolist(), size[chunk.end].tolist())]
    a, b = np.searchsorted(first, chunk.lo).tolist(), np.searchsorted(first, chunk.hi).tolist()
    total = chunk.hi - chunk.lo
    left = np.bincount(row, minlength=len(total))
    spans = [(first[x:y] - z, end[x:y] - first[x:y]) for x, y, z in zip(a, b, chunk.lo.tolist())]
    return pa.Table.from_arrays(
        [chunk.table["doc_id"].combine_chunks() if isinstance(chunk.table["doc_id"], pa.ChunkedArray) else chunk.table["doc_id"], pa.array(total), pa.array(left), pa.array([x for x, _ in spans], pa.list_(pa.int64())), pa.array([y for _, y in spans], pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string()), chunk.table["text_hash"]],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, sampled: int = 24, chunk_bytes: int = 1 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """For each row: its id, words, removed words, removed spans (in words), the text that stays (removed words go with the white
    space after them), and a hash of the text.

    A word is removed if a window of that many words covers it whose words also start anywhere else, in the same row or
    in another; all occurrences go. Null texts have no words; texts shorter than a window keep all; repeated rows remove
    each other. Null ids stay null. Other columns are ignored. sampled: as in suffix_dedup.
    """
    spec = partial(Spec, window - sampled + 1, sampled, True, False)
    return find_repeats(docs, id_col, text_col, spec, equal_windows, _finish, SCHEMA, chunk_bytes, bucket_bytes)
