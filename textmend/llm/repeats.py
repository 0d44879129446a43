"""Windows of fixed length that occur more than once, found exactly in two rounds.

A window is a string of k + w - 1 symbols (bytes or words). Among its w substrings of k symbols, the leftmost with the
smallest hash is its anchor, so equal windows have equal anchors at equal places. Successive windows with the same anchor
form a run; the run's text is its context, of which the anchor is a part.

The first round only rules out: every chunk sends the hash of each of its anchors, once, and learns which of them occur
elsewhere too. A window whose anchor doesn't can't be repeated. In the second round the texts of all other contexts are
compared, by the operator's own method (classes): first within the chunk, which then sends one text for each different
context, then in the anchor's bucket. There equal contexts are found first, and where an anchor has different ones (mostly
at the edges of a repeated passage), all their windows are compared. So no window is ever called repeated but by the
method, on its text; hashes tell apart, they never tell alike.

An anchor with very many contexts sends its windows one by one instead, dealt out by the hash of the whole window. A
passage that a third of all documents hold gives its bucket at most one text from each chunk. Chunks and buckets have a
bounded size, and every step depends only on its input, so lost executors cost a recomputation of their part and nothing
else.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, joined, lean, mix, planes, powers, ranges, rising, span_hashes, starts_of, unplanes, byte_values, word_spans
from .exchange import chunked, counts, sized

LAST = np.iinfo(np.int64).max
BLOB = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])


@dataclass(frozen=True)
class Spec:
    """words: symbols are words, else bytes. first: a window counts as repeated in a document if a smaller id has it, else
    if it occurs at any other place. local_hot: contexts of one anchor in a chunk, and hot: different marks (of 256) of an
    anchor's contexts in all chunks, beyond which its windows are dealt out one by one (the result is the same)."""

    k: int
    w: int
    words: bool
    first: bool
    buckets: int
    local_hot: int = 32
    hot: int = 160

    @property
    def window(self) -> int:
        return self.k + self.w - 1


def find_runs(sym: Callable, n: int, starts: np.ndarray, ends: np.ndarray, k: int, w: int, block: int = 1 << 16) -> dict:
    """Runs of windows with the same anchor inside [start, end) of each document: first window, number of windows, place of
    the anchor in the first window, 48-bit hash of the anchor and 40-bit hash of the context. sym(lo, hi): symbols."""
    W, out = k + w - 1, []
    fits = ends - starts >= W
    gs, ge = starts[fits], ends[fits] - W + 1
    bits = U((block + W).bit_length())
    low = (U(1) << bits) - U(1)
    place = np.arange(block + W, dtype=U)
    for lo in range(0, n, block):  # a block's arrays stay in the processor's cache
        a, b = np.searchsorted(ge, lo, "right"), np.searchsorted(gs, min(lo + block, n), "left")
        to = min(lo + block + W - 1, n)
        m = to - lo
        if a >= b or m < W:
            continue
        windows = m - W + 1
        edge = np.zeros(windows + 1, np.int8)
        edge[np.maximum(gs[a:b] - lo, 0)] += 1
        edge[np.minimum(ge[a:b] - lo, windows)] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        pw, inv = powers(m + 1)
        total = np.zeros(m + 1, U)
        np.cumsum(sym(lo, to) * pw[:m], out=total[1:])
        v = total[k:] - total[:-k]
        v *= inv[: m - k + 1]
        v = mix(v)
        least = v & ~low
        least |= place[: len(v)]
        have = 1
        while have < w:
            step = min(have, w - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        least &= low
        first = valid.copy()
        first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        js = np.flatnonzero(first)
        first |= ~valid
        breaks = np.append(np.flatnonzero(first), windows)
        nwin = breaks[np.searchsorted(breaks, js, "right")] - js
        at, size = least[js].astype(np.int64), nwin + W - 1
        ctx = mix(((total[js + size] - total[js]) * inv[js]) ^ mix((at - js).astype(U) * U(1 << 20) + size.astype(U)))
        # an anchor's hash is a minimum, so it's mixed again to be spread evenly over buckets
        out.append((js + lo, nwin, at - js, mix(v[at]) >> U(16), ctx >> U(24)))
    if not out:
        z = np.zeros(0, np.int64)
        out = [(z, z, z, z.astype(U), z.astype(U))]
    return dict(zip(("js", "nwin", "off", "key", "ctx"), map(np.concatenate, zip(*out))))


class Chunk:
    """The texts of a chunk in a fixed order, their runs, and their different anchors."""

    def __init__(self, table: pa.Table, spec: Spec):
        lean()
        self.spec = spec
        # rows come in any order; the same order each time makes the same runs
        self.table = table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        ids = pc.fill_null(table["doc_id"], LAST).to_numpy()
        data, start, end = joined(table["text"])
        self.data, self.start, self.end = data, start, end
        if spec.words:
            self.first, self.last = word_spans(data)
            self.values = span_hashes(data, self.first, self.last)
            self.lo = np.searchsorted(self.first, start)
            self.hi = np.searchsorted(self.first, end)
            sym, n = (lambda a, b: self.values[a:b]), len(self.first)
        else:
            values = byte_values()
            self.lo, self.hi = start, end
            sym, n = (lambda a, b: values[data[a:b]]), len(data)
        r = self.runs = find_runs(sym, n, self.lo, self.hi, spec.k, spec.w)
        row = np.searchsorted(self.hi, r["js"], "right")  # a run ends before its document does
        self.doc = ids[row]
        # runs in the order of their anchors, and the different anchors
        self.by = by = np.argsort(r["key"], kind="stable")
        key, doc = r["key"][by], self.doc[by]
        new = starts_of(key)
        self.at = g0 = np.flatnonzero(new)
        self.anchor = np.cumsum(new) - 1
        self.key = key[g0]
        self.size = np.diff(np.append(g0, len(by)))
        if spec.first:
            self.several = np.minimum.reduceat(doc, g0) != np.maximum.reduceat(doc, g0) if len(g0) else g0 > 0
        else:
            self.several = self.size > 1
        self.bucket = (self.key * U(spec.buckets) >> U(48)).astype(np.int64)  # in the order of keys

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each anchor that stands for its set of contexts, and whether they are too many for a chunk."""
        ctx = self.runs["ctx"][self.by]
        mark = (ctx[self.at] >> U(32)).astype(np.uint8) if len(self.at) else np.zeros(0, np.uint8)
        many = np.zeros(len(self.at), bool)
        some = self.size > 1  # only where an anchor occurs again its contexts have to be counted
        rows = np.flatnonzero(some[self.anchor])
        if len(rows):
            own = self.anchor[rows]
            by = np.lexsort((ctx[rows], own))
            own, c = own[by], ctx[rows][by]
            new = starts_of(own, c)
            own, c = own[new], c[new]
            at = np.flatnonzero(starts_of(own))
            mark[own[at]] = (mix(np.add.reduceat(c, at)) >> U(56)).astype(np.uint8)
            many[own[at]] = np.diff(np.append(at, len(own))) > self.spec.local_hot
        return mark, many

    def parts(self):
        """Bucket, first and end of its anchors."""
        if len(self.bucket):
            at = np.flatnonzero(starts_of(self.bucket))
            yield from zip(self.bucket[at].tolist(), at.tolist(), np.append(at[1:], len(self.bucket)).tolist())

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of the runs: first symbol, and place in runs."""
        n = self.runs["nwin"][runs]
        return ranges(self.runs["js"][runs], n), np.repeat(np.arange(len(runs)), n)

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        W = self.spec.window
        hashes = np.empty(len(at), U)
        pw = powers(W)[0]
        for i in range(0, len(at), 1 << 14):
            index = at[i : i + (1 << 14), None] + np.arange(W)
            block = self.values[index] if self.spec.words else byte_values()[self.data[index]]
            hashes[i : i + (1 << 14)] = mix((block * pw).sum(axis=1, dtype=U))
        return hashes

    def texts(self, first: np.ndarray, size: np.ndarray) -> bytes:
        """The texts of size symbols from first on, one after another; each word is followed by a space."""
        if not self.spec.words:
            return self.data[ranges(first, size)].tobytes()
        words = ranges(first, size)
        n = self.last[words] - self.first[words] + 1  # with the byte after it, which is white space
        out = self.data[ranges(self.first[words], n)].copy()
        out[np.cumsum(n) - 1] = 32
        return out.tobytes()


def symbols_of(spec: Spec, text: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of such texts (words as numbers, equal ones alike), and where each text starts."""
    if spec.words:
        known: dict = {}
        symbols = np.fromiter((known.setdefault(x, len(known)) for x in text[:-1].split(b" ")), np.int64) if text else np.zeros(0, np.int64)
    else:
        symbols = np.frombuffer(text, np.uint8)
    return symbols, np.cumsum(size, dtype=np.int64) - size


def alike(spec: Spec, classes: Callable, texts: Callable, depth: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers the texts of depth symbols, equal ones alike. Only texts with equal keys and depths can be equal; texts(rows)
    gives the texts of some rows, one after another."""
    out = np.empty(len(depth), np.int64)
    by = np.lexsort((*keys, depth))
    segment = np.cumsum(starts_of(depth[by], *(k[by] for k in keys))) - 1
    alone = np.bincount(segment)[segment] == 1 if len(by) else np.zeros(0, bool)
    out[by[alone]] = np.arange(int(alone.sum()))
    rest = by[~alone]
    if len(rest):
        symbols, first = symbols_of(spec, texts(rest), depth[rest])
        out[rest] = classes(symbols, first, np.cumsum(starts_of(segment[~alone])) - 1, depth[rest]) + int(alone.sum())
    return out


class Contexts:
    """What a chunk sends in the second round: each different context of its anchors that occur again, and each different
    window of those that are dealt out. state of the anchors: 1 is compared, 2 is dealt out, 0 is ruled out."""

    def __init__(self, chunk: Chunk, state: np.ndarray, classes: Callable):
        spec, r, W = chunk.spec, chunk.runs, chunk.spec.window
        told = state[chunk.anchor] if len(chunk.anchor) else np.zeros(0, np.uint8)
        self.run = chunk.by[told == 1]
        size = r["nwin"][self.run] + W - 1
        own = alike(spec, classes, lambda i: chunk.texts(r["js"][self.run[i]], size[i]), size, r["off"][self.run], r["ctx"][self.run], r["key"][self.run])
        dealt = chunk.by[told == 2]
        self.at, which = chunk.windows(dealt)
        hashes = chunk.window_hashes(self.at)
        full = np.full(len(self.at), W)
        each = alike(spec, classes, lambda i: chunk.texts(self.at[i], full[i]), full, hashes)
        runs, wins = len(self.run), len(self.at)
        # runs and windows together, in the order of their entries
        doc = np.concatenate([chunk.doc[self.run], chunk.doc[dealt][which]])
        number = np.concatenate([own, each + (int(own.max()) + 1 if runs else 0)])
        by = np.lexsort((doc, number))
        new = starts_of(number[by])
        g0 = np.flatnonzero(new)
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        rep, self.doc = by[g0], doc[by][g0]
        g1 = np.append(g0[1:], len(by))[: len(g0)]
        self.several = doc[by][g1 - 1] != self.doc if spec.first else (g1 - g0) > 1
        self.later = doc > self.doc[self.entry] if spec.first else np.zeros(len(by), bool)
        self.dealt = rep >= runs
        join = lambda a, b: np.concatenate([a, b])[rep]
        self.seg = join(r["key"][self.run], hashes)
        self.js, self.nwin = join(r["js"][self.run], self.at), join(r["nwin"][self.run], np.ones(wins, np.int64))
        self.off = join(r["off"][self.run], np.zeros(wins, np.int64))
        self.buckets = spec.buckets

    def parts(self):
        """Bucket and its entries."""
        bucket = (mix(self.seg) % U(self.buckets)).astype(np.int64)
        by = np.lexsort((self.js, bucket))
        cut = np.flatnonzero(starts_of(bucket[by])).tolist()
        for a, z in zip(cut, [*cut[1:], len(by)]):
            yield int(bucket[by[a]]), by[a:z]


def blobs(rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else ((), (), ()), BLOB)], schema=BLOB)


def send_anchors(spec: Spec, table: pa.Table) -> pa.Table:
    """For each bucket the hashes of the chunk's anchors, in order, as differences, each with its mark and two flags."""
    chunk = Chunk(table, spec)
    number = table["chunk"][0].as_py()
    mark, many = chunk.marks()
    rows = []
    for b, a, z in chunk.parts():
        key = chunk.key[a:z].copy()
        key[1:] -= chunk.key[a : z - 1]
        rows.append((b, number, np.int32(z - a).tobytes() + planes(key, 6) + mark[a:z].tobytes() + np.packbits(np.concatenate([chunk.several[a:z], many[a:z]])).tobytes()))
    return blobs(rows)


def answer_anchors(spec: Spec, table: pa.Table) -> pa.Table:
    """For a bucket: the state of each chunk's anchors. One that is in one chunk only, and there in one document (or place)
    only, is ruled out."""
    lean()
    parts, size = [], []
    for raw in table["payload"].to_pylist():
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        flags = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 7 * n), count=2 * n).astype(bool)
        parts.append((np.cumsum(unplanes(raw, n, 6, 4)), np.frombuffer(raw, np.uint8, n, 4 + 6 * n), flags[:n], flags[n:]))
        size.append(n)
    key, mark, several, many = map(np.concatenate, zip(*parts))
    by = np.lexsort((mark, key))
    new = starts_of(key[by])
    g0 = np.flatnonzero(new)
    live = (np.diff(np.append(g0, len(by))) > 1) | np.logical_or.reduceat(several[by], g0)
    hot = np.logical_or.reduceat(many[by], g0) | (np.add.reduceat(starts_of(key[by], mark[by]).astype(np.int64), g0) > spec.hot)
    state = np.empty(len(by), np.uint8)
    state[by] = np.where(live, np.where(hot, 2, 1), 0).astype(np.uint8)[np.cumsum(new) - 1]
    ends = np.cumsum(size)
    rows = []
    for b, c, z, n in zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), ends.tolist(), size):
        mine = state[z - n : z]
        if mine.any():
            rows.append((b, c, np.packbits(np.concatenate([mine == 1, mine == 2])).tobytes()))
    return blobs(rows)


def take_states(chunk: Chunk, replies: pa.Table) -> np.ndarray:
    """The state of each anchor."""
    state = np.zeros(len(chunk.key), np.uint8)
    span = {b: (a, z) for b, a, z in chunk.parts()}
    for b, raw in zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist()):
        if b >= 0:
            a, z = span[b]
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * (z - a))
            state[a:z] = bits[: z - a] + 2 * bits[z - a :]
    return state


def send_contexts(spec: Spec, classes: Callable, table: pa.Table, replies: pa.Table) -> pa.Table:
    if not len(table) or not len(replies):
        return blobs([])
    chunk = Chunk(table, spec)
    c = Contexts(chunk, take_states(chunk, replies), classes)
    rows, number = [], table["chunk"][0].as_py()
    for b, t in c.parts():
        size = c.nwin[t] + spec.window - 1
        body = np.int32(len(t)).tobytes() + c.nwin[t].astype(np.uint8).tobytes() + c.off[t].astype(np.uint8).tobytes() + planes(c.doc[t], 8) + np.packbits(np.concatenate([c.several[t], c.dealt[t]])).tobytes()
        rows.append((b, number, zlib.compress(body + chunk.texts(c.js[t], size), 1)))
    return blobs(rows)


def read_contexts(raw: bytes) -> tuple[dict, bytes]:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 4), 4 + 10 * n), count=2 * n).astype(bool)
    e = {"nwin": np.frombuffer(raw, np.uint8, n, 4).astype(np.int64), "off": np.frombuffer(raw, np.uint8, n, 4 + n).astype(np.int64), "doc": unplanes(raw, n, 8, 4 + 2 * n).view(np.int64), "several": bits[:n], "dealt": bits[n:]}
    return e, raw[4 + 10 * n + -(-n // 4) :]


class Hashes:
    """Hashes of stretches of symbols, to be compared with each other only."""

    def __init__(self, symbols: np.ndarray):
        pw = rising(len(symbols) + 1)
        self.total, self.lift = np.zeros(len(symbols) + 1, U), pw[::-1]
        values = byte_values()[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(U) + U(1))
        np.cumsum(values * pw[:-1], out=self.total[1:])

    def of(self, first: np.ndarray, size) -> np.ndarray:
        return (self.total[first + size] - self.total[first]) * self.lift[first]


def answer_contexts(spec: Spec, classes: Callable, table: pa.Table) -> pa.Table:
    """For a bucket: which windows of each context are repeated, as bits. classes(symbols, first, segment, depth) numbers the
    texts of depth symbols at first, equal ones in a segment alike; it's the operator's method."""
    lean()
    bodies, texts = zip(*(read_contexts(x) for x in table["payload"].to_pylist()))
    e = {k: np.concatenate([b[k] for b in bodies]) for k in ("nwin", "off", "doc", "several", "dealt")}
    ends = np.cumsum([len(b["nwin"]) for b in bodies])
    nwin, off = e["nwin"], e["off"]
    size = nwin + spec.window - 1
    symbols, base = symbols_of(spec, b"".join(texts), size)
    del texts, bodies
    hashes = Hashes(symbols)
    # the anchor, or the window that is dealt out
    e["seg"] = hashes.of(base + np.where(e["dealt"], 0, off), np.where(e["dealt"], spec.window, spec.k))
    # equal contexts: of the same size, with the anchor at the same place; hashes rule out the others
    ctx, form = hashes.of(base, size), (off * 64 + nwin) * 2 + e["dealt"]
    by = np.lexsort((form, ctx))
    segment = np.cumsum(starts_of(ctx[by], form[by])) - 1
    alone = np.bincount(segment)[segment] == 1
    own = np.empty(len(by), np.int64)
    own[by[alone]] = np.arange(int(alone.sum()))
    rest = by[~alone]
    if len(rest):
        own[rest] = classes(symbols, base[rest], np.cumsum(starts_of(segment[~alone])) - 1, size[rest]) + int(alone.sum())
    n = int(own.max()) + 1
    rep = np.empty(n, np.int64)
    rep[own] = np.arange(len(own))
    if spec.first:
        low = np.full(n, LAST)
        np.minimum.at(low, own, e["doc"])
    else:
        times = np.bincount(own, weights=1 + e["several"], minlength=n).astype(np.int64)
    # where an anchor has one context, its windows are repeated as it is
    whole = (low[own] < e["doc"]) if spec.first else times[own] > 1
    mask = np.where(whole, (U(1) << nwin.astype(U)) - U(1), U(0))
    # where it has several, their windows are compared where the anchor lies at the same place
    by = np.lexsort((e["seg"][rep], e["dealt"][rep]))
    group = np.cumsum(starts_of(e["seg"][rep][by], e["dealt"][rep][by])) - 1
    mixed = np.zeros(n, bool)
    mixed[by] = np.bincount(group)[group] > 1
    some = np.flatnonzero(mixed)
    if len(some):
        r = rep[some]
        at = np.cumsum(nwin[r]) - nwin[r]  # where each context's windows are listed
        which = np.repeat(np.arange(len(r)), nwin[r])
        place = np.arange(len(which)) - at[which]
        start = base[r][which] + place
        form, win = (off[r][which] - place + 64) * 2 + e["dealt"][r][which], hashes.of(start, spec.window)
        by = np.lexsort((form, win))
        segment = np.cumsum(starts_of(win[by], form[by])) - 1
        alone = np.bincount(segment)[segment] == 1
        cls = np.empty(len(which), np.int64)
        cls[by[alone]] = np.arange(int(alone.sum()))
        rest = by[~alone]
        if len(rest):
            cls[rest] = classes(symbols, start[rest], np.cumsum(starts_of(segment[~alone])) - 1, np.full(len(rest), spec.window)) + int(alone.sum())
        m = int(cls.max()) + 1
        if spec.first:
            least = np.full(m, LAST)
            np.minimum.at(least, cls, low[some][which])
        else:
            count = np.bincount(cls, weights=times[some][which], minlength=m)
        index = np.full(n, -1)
        index[some] = np.arange(len(some))
        ent = np.flatnonzero(mixed[own])
        c = index[own[ent]]
        wide = np.repeat(np.arange(len(ent)), nwin[ent])
        win = ranges(at[c], nwin[ent])
        repeated = least[cls[win]] < e["doc"][ent][wide] if spec.first else count[cls[win]] > 1
        mask[ent] = 0
        np.bitwise_or.at(mask, ent[wide[repeated]], U(1) << place[win[repeated]].astype(U))
    kind = np.uint32 if spec.w <= 32 else np.uint64
    rows = []
    for b, c, a, z in zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), [0, *ends.tolist()], ends.tolist()):
        if mask[a:z].any():
            rows.append((-1 - b, c, zlib.compress(mask[a:z].astype(kind).tobytes(), 1)))
    return blobs(rows)


def covered(chunk: Chunk, replies: pa.Table, classes: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of symbols covered by repeated windows: firsts and ends, in order."""
    r, W = chunk.runs, chunk.spec.window
    c = Contexts(chunk, take_states(chunk, replies), classes)
    mask = np.zeros(len(c.doc), U)
    entries = dict(c.parts())
    for b, raw in zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist()):
        if b < 0:
            mask[entries[-1 - b]] = np.frombuffer(zlib.decompress(raw), np.uint32 if chunk.spec.w <= 32 else np.uint64)
    runs = len(c.run)
    told = mask[c.entry] if len(c.entry) else np.zeros(0, U)
    # a document after the first one that has the context here repeats it as a whole
    later = c.run[c.later[:runs]]
    first, end = [r["js"][later]], [r["js"][later] + r["nwin"][later] + W - 1]
    some = ~c.later[:runs] & (told[:runs] > 0)
    at, which = chunk.windows(c.run[some])
    on = (told[:runs][some][which] >> (at - r["js"][c.run[some]][which]).astype(U)) & U(1) == 1
    on = np.concatenate([on, c.later[runs:] | (told[runs:] > 0)])
    at = np.concatenate([at, c.at])[on]
    first, end = np.concatenate([*first, at]), np.concatenate([*end, at + W])
    if not len(first):
        return first, end
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(end[by])
    new = np.ones(len(first), bool)
    row = np.searchsorted(chunk.hi, first, "right")  # stretches of different texts may touch
    new[1:] = (first[1:] > end[:-1]) | (row[1:] != row[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return first[new], end[last]


def find_repeats(docs: DataFrame, id_col: str, text_col: str, spec: Callable, classes: Callable, finish: Callable, schema: str, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """Runs the rounds; finish(chunk, firsts, ends) makes the result's rows. spec(buckets) gives the Spec."""
    chunks, buckets = counts(sized(docs, text_col), chunk_bytes, bucket_bytes)
    s = spec(buckets)
    rows = chunked(docs, {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string"), "text_hash": F.xxhash64(F.col(text_col).cast("string"))}, [F.col(id_col), F.col(text_col).cast("string")], chunks)
    blob = "bucket int, chunk int, payload binary"

    # named here, so that they are plain functions of tables for Spark
    def one(table: pa.Table) -> pa.Table:
        return send_anchors(s, table)

    def two(table: pa.Table) -> pa.Table:
        return answer_anchors(s, table)

    def three(table: pa.Table, replies: pa.Table) -> pa.Table:
        return send_contexts(s, classes, table, replies)

    def four(table: pa.Table) -> pa.Table:
        return answer_contexts(s, classes, table)

    def five(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, s)
        return finish(chunk, *covered(chunk, replies, classes))

    by_chunk = rows.groupBy("chunk")
    told = by_chunk.applyInArrow(one, blob).groupBy("bucket").applyInArrow(two, blob)
    more = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(three, blob).groupBy("bucket").applyInArrow(four, blob)
    return by_chunk.cogroup(told.unionAll(more).groupBy("chunk")).applyInArrow(five, schema)
