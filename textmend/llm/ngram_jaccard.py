"""N-gram Jaccard join: documents whose sets of word shingles are similar are linked, by a token-group matrix.

Equal sets are one class. A class belongs to the group of its smallest shingle hash, so similar classes mostly share a
group. Two sets with similarity t share at least m shingles among the n - ceil(t n) + m rarest of each, so these rare
shingles are the matrix's rows to look at.

A first round tells which of a class's rare shingles another class holds. The others are its own: what it has in common
with any class is bounded by its size less those, and the union by the other's size and those. A class that has too few
shared or too many own shingles is done with. In a second round, where a shingle is held by classes of different groups,
those of the group with fewer of them visit the other, if the bounds of both groups allow it; pairs that they don't allow
aren't listed. That may be the one group at some shingles and the other at others, so at one of both places at least m / 2
are counted: a visitor that shares fewer of its rare shingles with the union of a group's isn't sent there, and neither is
a member that shares fewer with all others. A group that is visited takes the union of its members' whole sets; a visitor
that shares less than ceil(t n) with the union can't be similar to any member, and the group isn't opened for it. Within
an opened group, sets are compared exactly.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, joined, lean, lower_ascii, mix, pieces, planes, powers, ranges, span_hashes, starts_of, unplanes, word_spans
from .components import components
from .exchange import checkpointed, chunked, counts, sized, summed
from .repeats import blobs

SLOTS = 1 << 18


def at_least(n):
    """m for a set of n shingles."""
    return n // 8


def told_at_least(n, num: int, den: int):
    """Half the rare shingles that a set of n shares with any similar one, which are m of the smaller set's size."""
    return np.maximum(1, (at_least((num * n + den - 1) // den) + 1) // 2)


def shingle_sets(col, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each different shingle, in this order."""
    lean()
    data, start, end = joined(col)
    data = lower_ascii(data)
    first, last = word_spans(data)
    h = span_hashes(data, first, last)
    lo, hi = np.searchsorted(first, start), np.searchsorted(first, end)
    pw = powers(words + 1)[0]
    size = hi - lo
    n = np.where(size >= words, size - words + 1, 0)
    at = ranges(lo, n)
    doc = np.repeat(np.arange(len(lo)), n)
    total = np.full(len(at), words, U)
    for j in range(words):
        total += h[at + j] * pw[j + 1]
    few = np.flatnonzero((size > 0) & (size < words))
    short = size[few].astype(U)
    for j in range(words - 1):
        on = size[few] > j
        short[on] += h[lo[few[on]] + j] * pw[j + 1]
    total = mix(np.concatenate([total, short]))
    doc = np.concatenate([doc, few])
    by = np.argsort(total, kind="stable")
    by = by[np.argsort(doc[by].astype(np.uint16) if len(lo) < 1 << 16 else doc[by], kind="stable")]
    doc, total = doc[by], total[by]
    new = starts_of(doc, total)
    return doc[new], total[new]


def classes_of(doc: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of its shingles and a 63-bit class number of its set (0 if empty)."""
    n = np.bincount(doc, minlength=rows)
    number = np.zeros(rows, U)
    if len(doc):
        at = np.flatnonzero(starts_of(doc))
        number[doc[at]] = mix(np.add.reduceat(mix(token ^ U(0xA5A5A5A5A5A5A5A5)), at) + n[doc[at]].astype(U)) >> U(1)
    return n, number.view(np.int64)


class Sets:
    """The different sets of a chunk, with each one's rarest shingles first."""

    def __init__(self, table: pa.Table, words: int, rarity: np.ndarray, num: int, den: int):
        doc, token = shingle_sets(table["text"], words)
        n, number = classes_of(doc, token, len(table))
        at = np.searchsorted(doc, np.arange(len(table)))
        have = np.flatnonzero(n)
        self.number, which = np.unique(number[have], return_index=True)
        rows = have[which]
        self.n = n[rows]
        self.token = token[ranges(at[rows], self.n)]
        owner = np.repeat(np.arange(len(rows)), self.n)
        self.at = np.cumsum(self.n) - self.n
        self.group = np.minimum.reduceat(mix(self.token ^ U(0x5851F42D4C957F2D)), self.at) if len(rows) else self.token
        rank = np.minimum(rarity[(self.token & U(SLOTS - 1)).astype(np.int64)], (1 << 24) - 1).astype(U) << U(40) | self.token >> U(24)
        by = np.argsort(rank, kind="stable")
        self.token = self.token[by[np.argsort(owner[by].astype(np.uint16) if len(rows) < 1 << 16 else owner[by], kind="stable")]]
        self.prefix = self.n - (num * self.n + den - 1) // den + np.maximum(1, at_least(self.n))


def common_room(n, own, num: int, den: int):
    """How many own shingles a set may have at most to be similar to one of n shingles, own of which no other set holds; below
    zero if none can. What both share is at most n - own, and their union at least n and the other's own."""
    return (den * (n - own) - num * n) // num


class Prefixes:
    """The rare shingles of a chunk's classes, and the different ones among them, in order, for each bucket."""

    def __init__(self, s: Sets, buckets: int):
        self.owner = np.repeat(np.arange(len(s.n)), s.prefix)
        self.token = s.token[ranges(s.at, s.prefix)]
        bucket = (mix(self.token) % U(buckets)).astype(np.int64)
        low = self.token & U((1 << 40) - 1)
        by = np.lexsort((low, bucket))
        new = starts_of(bucket[by], low[by])
        at = np.flatnonzero(new)
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.at_bucket, self.bucket, self.low = bucket, bucket[by][at], low[by][at]
        self.several = np.diff(np.append(at, len(by))) > 1
        self.mark = np.where(self.several, 0, s.number[self.owner[by][at]]).view(U) >> U(23)

    def parts(self):
        """Bucket, first and end of its entries."""
        cut = np.flatnonzero(starts_of(self.bucket)).tolist()
        yield from zip(self.bucket[cut].tolist(), cut, [*cut[1:], len(self.bucket)])


def send_tokens(make, buckets: int, table: pa.Table) -> pa.Table:
    """For each bucket the chunk's rare shingles, in order, as differences, with the class that holds each, if it's one."""
    p, number, rows = Prefixes(make(table), buckets), table["chunk"][0].as_py(), []
    for b, a, z in p.parts():
        low = p.low[a:z].copy()
        low[1:] -= p.low[a : z - 1]
        rows.append((b, number, np.int32(z - a).tobytes() + planes(low, 5) + planes(p.mark[a:z], 5) + np.packbits(p.several[a:z]).tobytes()))
    return blobs(rows)


def answer_tokens(table: pa.Table) -> pa.Table:
    """For a bucket: which of each chunk's shingles are held by more than one class."""
    lean()
    parts, size = [], []
    for raw in table["payload"].to_pylist():
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        parts.append((np.cumsum(unplanes(raw, n, 5, 4)), unplanes(raw, n, 5, 4 + 5 * n), np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 10 * n), count=n).astype(bool)))
        size.append(n)
    token, mark, several = map(np.concatenate, zip(*parts))
    by = np.argsort(token, kind="stable")
    new = starts_of(token[by])
    g0 = np.flatnonzero(new)
    mark = mark[by]
    live = np.logical_or.reduceat(several[by], g0) | (np.minimum.reduceat(mark, g0) != np.maximum.reduceat(mark, g0))
    state = np.empty(len(by), bool)
    state[by] = live[np.cumsum(new) - 1]
    rows = []
    for b, c, z, n in zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), np.cumsum(size).tolist(), size):
        if state[z - n : z].any():
            rows.append((b, c, np.packbits(state[z - n : z]).tobytes()))
    return blobs(rows)


def send_prefixes(make, num: int, den: int, buckets: int, table: pa.Table, replies: pa.Table) -> pa.Table:
    """The shared rare shingles of classes that may be similar to another."""
    if not len(table) or not len(replies):
        return blobs([])
    s: Sets = make(table)
    p = Prefixes(s, buckets)
    live = np.zeros(len(p.low), bool)
    span = {b: (a, z) for b, a, z in p.parts()}
    for b, raw in zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist()):
        a, z = span[b]
        live[a:z] = np.unpackbits(np.frombuffer(raw, np.uint8), count=z - a).astype(bool)
    live = live[p.entry]
    shared = np.bincount(p.owner[live], minlength=len(s.n))
    own = s.prefix - shared
    able = (shared >= np.maximum(1, at_least((num * s.n + den - 1) // den))) & (common_room(s.n, own, num, den) >= 0)
    keep = np.flatnonzero(live & able[p.owner])
    owner, token, bucket = p.owner[keep], p.token[keep], p.at_bucket[keep]
    by = np.argsort(bucket, kind="stable")
    rows, number = [], table["chunk"][0].as_py()
    cut = np.flatnonzero(starts_of(bucket[by])).tolist() if len(by) else []
    for a, z in zip(cut, [*cut[1:], len(by)]):
        t = by[a:z]
        o = owner[t]
        rows.append((int(bucket[t[0]]), number, np.int32(len(t)).tobytes() + planes(token[t], 5) + planes(s.number[o], 8) + planes(s.group[o] >> U(32), 4) + planes(s.n[o], 4) + planes(own[o], 4)))
    return blobs(rows)


def place(group: np.ndarray, depth: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A number for a block of a group."""
    return mix(group + (depth.astype(U) << U(56)) + mix(block.astype(U) + U(1)))


def squeezed(out: list) -> list:
    """The same rows (class, place, role, chunk, times), each class and place once, in the order of chunks."""
    number, where, role, chunk, times = map(np.concatenate, zip(*out))
    by = np.lexsort((role, where, number, chunk))
    first = np.flatnonzero(starts_of(chunk[by], number[by], where[by]))
    at = by[first]
    return [(number[at], where[at], role[at], chunk[at], np.minimum(np.add.reduceat(times[by], first), 1 << 30) if len(first) else times)]


def find_visits(num: int, den: int, most: int, table: pa.Table) -> pa.Table:
    """For a bucket of shingles: which classes are members (0) and which are visitors (1) of which group's block, and by how
    many shingles; 255 for that many or more, which is taken as enough, and if the block is one of a large group's, whose
    shingles aren't counted together."""
    lean()
    parts = []
    for c, raw in zip(table["chunk"].to_pylist(), table["payload"].to_pylist()):
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        parts.append((unplanes(raw, n, 5, 4), unplanes(raw, n, 8, 4 + 5 * n), unplanes(raw, n, 4, 4 + 13 * n), unplanes(raw, n, 4, 4 + 17 * n).astype(np.int64), unplanes(raw, n, 4, 4 + 21 * n).astype(np.int64), np.full(n, c)))
    token, number, group, n, own, chunk = map(np.concatenate, zip(*parts))
    by = np.lexsort((chunk, number, group, token))
    token, number, group, n, own, chunk = (x[by] for x in (token, number, group, n, own, chunk))
    one = starts_of(token, number)  # a class counts once, where its first chunk is
    token, number, group, n, own, chunk = (x[one] for x in (token, number, group, n, own, chunk))
    t0 = np.flatnonzero(starts_of(token))
    size = np.diff(np.append(t0, len(token)))
    keep = np.repeat(size > 1, size)
    token, number, group, n, own, chunk = (x[keep] for x in (token, number, group, n, own, chunk))
    if not len(token):
        return blobs([])
    room = common_room(n, own, num, den)
    new = starts_of(token, group)
    g0 = np.flatnonzero(new)  # groups at a token
    gsize = np.diff(np.append(g0, len(token)))
    gof = np.cumsum(new) - 1
    least, greatest = np.minimum.reduceat(n, g0), np.maximum.reduceat(n, g0)
    low, high = np.minimum.reduceat(own, g0), np.maximum.reduceat(room, g0)
    depth = np.zeros(len(g0), np.int64)
    big = gsize > most
    depth[big] = np.ceil(np.log2(gsize[big] / most)).astype(np.int64)
    spread = mix(number)
    block = np.where(depth[gof] > 0, (spread >> (U(63) - depth[gof].astype(U)) >> U(1)).astype(np.int64), 0)
    home = place(group, depth[gof], block)
    out: list = []  # class, place, role, chunk, times

    def put(rows: np.ndarray, where: np.ndarray, role: int) -> None:
        out.append((number[rows], where, np.full(len(rows), role, np.int8), chunk[rows], np.ones(len(rows), np.int64)))
        if sum(len(x[0]) for x in out) > 1 << 22:
            out[:] = squeezed(out)

    # classes of one group at a token are members of it, if one of it may be similar to them
    able = (gsize[gof] > 1) & (room >= low[gof]) & (own <= high[gof])
    put(np.flatnonzero(able), home[able], 0)
    for g in np.flatnonzero(big).tolist():  # later blocks of a large group visit earlier ones
        rows = np.arange(g0[g], g0[g] + gsize[g])
        rows = rows[able[rows]]
        for b in range(1 << int(depth[g])):
            go = rows[block[rows] > b]
            put(go, np.full(len(go), place(group[go[:1]], depth[g : g + 1], np.array([b]))[0] if len(go) else 0, U), 1)
    # groups at one token, in the order of their fewest own shingles: each is paired with earlier ones that leave it room
    order = np.lexsort((group[g0], low, token[g0]))
    s0 = np.flatnonzero(starts_of(token[g0]))
    tsize = np.diff(np.append(s0, len(g0)))
    base = np.repeat(s0, tsize)
    rank = np.arange(len(g0)) - base
    wide = U(int(max(low.max(), high.max(), 0)) + 2)
    at_token = np.repeat(np.arange(len(s0)), tsize).astype(U) * wide
    fit = np.searchsorted(at_token + low[order].astype(U), at_token + (np.maximum(high[order], -1) + 1).astype(U), "left") - base
    mine = np.minimum(rank, np.clip(fit, 0, None))
    pairs = np.cumsum(mine)
    at = 0
    while at < len(g0):  # so many pairs at a time
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (1 << 20), "right")))
        x, y = order[ranges(base[at:to], mine[at:to])], order[np.repeat(np.arange(at, to), mine[at:to])]
        at = to
        fits = (low[y] <= high[x]) & (num * least[x] <= den * greatest[y]) & (num * least[y] <= den * greatest[x])
        x, y = x[fits], y[fits]
        # of each pair the one with fewer classes visits
        fewer = (gsize[x] < gsize[y]) | ((gsize[x] == gsize[y]) & (group[g0[x]] < group[g0[y]]))
        small, large = np.where(fewer, x, y), np.where(fewer, y, x)
        rows, host = ranges(g0[small], gsize[small]), np.repeat(large, gsize[small])
        fits = (num * n[rows] <= den * greatest[host]) & (num * least[host] <= den * n[rows]) & (room[rows] >= low[host]) & (own[rows] <= high[host])
        rows, host = rows[fits], host[fits]
        if not len(rows):
            continue
        hosts = np.unique(host)
        members = ranges(g0[hosts], gsize[hosts])
        put(members, home[members], 0)
        for d in np.unique(depth[host]).tolist():
            deep = depth[host] == d
            r, h = rows[deep], g0[host[deep]]
            for b in range(1 << d):
                put(r, place(group[h], np.full(len(r), d), np.full(len(r), b)), 1)
    number, where, role, chunk, times = squeezed(out)[0]
    large = np.unique(np.concatenate([np.zeros(0, U), *(place(group[g0[g : g + 1]], depth[g : g + 1], np.array([b])) for g in np.flatnonzero(big).tolist() for b in range(1 << int(depth[g])))]))
    times = np.where(np.isin(where, large), 255, np.minimum(times, 255)).astype(np.uint8)
    rows = []
    cut = np.flatnonzero(starts_of(chunk)).tolist() if len(chunk) else []
    for a, z in zip(cut, [*cut[1:], len(chunk)]):
        rows.append((-1, int(chunk[a]), np.int32(z - a).tobytes() + planes(number[a:z], 8) + planes(where[a:z], 8) + role[a:z].tobytes() + times[a:z].tobytes()))
    return blobs(rows)


def send_sets(make, num: int, den: int, buckets: int, table: pa.Table, replies: pa.Table) -> pa.Table:
    if not len(table) or not len(replies):
        return blobs([])
    s: Sets = make(table)
    parts = []
    for raw in replies["payload"].to_pylist():
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        parts.append((unplanes(raw, n, 8, 4), unplanes(raw, n, 8, 4 + 8 * n), np.frombuffer(raw, np.int8, n, 4 + 16 * n), np.frombuffer(raw, np.uint8, n, 4 + 17 * n)))
    number, where, role, times = map(np.concatenate, zip(*parts))
    by = np.lexsort((role, number, where))
    number, where, role, times = number[by], where[by], role[by], times[by]
    first = np.flatnonzero(starts_of(where, number))
    uncounted = np.maximum.reduceat(times, first) == 255
    times = np.add.reduceat(times.astype(np.int64), first)
    number, where, role = number[first].view(np.int64), where[first], role[first]
    index = np.searchsorted(s.number, number)
    enough = uncounted | (times >= told_at_least(s.n[index], num, den))
    number, where, role, index = (x[enough] for x in (number, where, role, index))
    bucket = (mix(where) % U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    rows, me = [], table["chunk"][0].as_py()
    cut = np.flatnonzero(starts_of(bucket[by])).tolist() if len(by) else []
    for a, z in zip(cut, [*cut[1:], len(by)]):
        t = by[a:z]
        i, of = np.unique(index[t], return_inverse=True)  # each set once, however many places of the bucket it goes to
        tokens = s.token[ranges(s.at[i], s.n[i])]
        rows.append((int(bucket[t[0]]), me, pickle.dumps((number[t], where[t], role[t], of.astype(np.uint32), s.n[i].astype(np.uint32), planes(tokens >> U(8), 7)), 5)))
    return blobs(rows)


def link_group(token: np.ndarray, at: np.ndarray, n: np.ndarray, role: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component of each set within a group: members are compared until connected, visitors if the union's bound lets them.
    token: dense numbers; at, n: each set's place and size."""
    mark = np.zeros(int(token.max()) + 1, bool)
    comp = np.arange(len(n))

    def shared(x: int, rows: np.ndarray) -> np.ndarray:
        own = token[at[x] : at[x] + n[x]]
        mark[own] = True
        where = ranges(at[rows], n[rows])
        out = np.add.reduceat(mark[token[where]], np.cumsum(n[rows]) - n[rows], dtype=np.int64)
        mark[own] = False
        return out

    def similar(x: int, rows: np.ndarray) -> np.ndarray:
        fits = rows[(num * n[rows] <= den * n[x]) & (num * n[x] <= den * n[rows])]
        if not len(fits):
            return fits
        both = shared(x, fits)
        return fits[den * both >= num * (n[fits] + n[x] - both)]

    members = left = np.flatnonzero(role == 0)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        head = todo[0]
        while todo and len(left):
            found = similar(todo.pop(), left)
            if len(found):
                comp[found] = head
                todo.extend(found.tolist())
                left = left[~np.isin(left, found)]
    visitors = np.flatnonzero(role == 1)
    if len(members) and len(visitors):
        union = np.zeros(len(mark), bool)
        union[token[ranges(at[members], n[members])]] = True
        bound = np.add.reduceat(union[token[ranges(at[visitors], n[visitors])]], np.cumsum(n[visitors]) - n[visitors], dtype=np.int64)
        for v in visitors[den * bound >= num * n[visitors]].tolist():
            heads = np.unique(comp[similar(v, members)])
            if len(heads):
                least = min(int(heads[0]), int(comp[v]))
                comp[np.isin(comp, np.append(heads, comp[v]))] = least
    return comp


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def find_links(num: int, den: int, table: pa.Table) -> pa.Table:
    lean()
    number, where, role, of, n, raw = zip(*(pickle.loads(x) for x in table["payload"].to_pylist()))
    token = np.concatenate([unplanes(r, int(k.sum()), 7) for r, k in zip(raw, n)])
    sets = np.cumsum([0, *(len(k) for k in n)])
    of = np.concatenate([o.astype(np.int64) + k for o, k in zip(of, sets)])
    number, where, role, n = map(np.concatenate, (number, where, role, n))
    n = n.astype(np.int64)
    at = (np.cumsum(n) - n)[of]
    n = n[of]
    by = np.lexsort((role, number, where))
    by = by[starts_of(where[by], number[by])]
    cut = np.flatnonzero(starts_of(where[by])).tolist()
    a, b = [], []
    for i, j in zip(cut, [*cut[1:], len(by)]):
        g = by[i:j]
        if len(g) < 2:
            continue
        _, dense = np.unique(token[ranges(at[g], n[g])], return_inverse=True)
        comp = link_group(dense, np.cumsum(n[g]) - n[g], n[g], role[g], num, den)
        other = np.flatnonzero(comp != np.arange(len(g)))
        a.append(number[g][other])
        b.append(number[g][comp[other]])
    z = np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(np.concatenate([z, *x])) for x in (a, b)], schema=LINKS)


def shingle_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many documents hold a shingle of each of SLOTS hash slots; the size doesn't depend on the data."""

    def count(batch) -> np.ndarray:
        _, token = shingle_sets(batch.column(0), words)
        return np.bincount((token & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)

    return summed(docs.select(F.col(text_col).cast("string").alias("text")), count, SLOTS)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, chunk_bytes: int = 1 << 20, bucket_bytes: int = 4 << 20, block: int = 4096) -> DataFrame:
    """For each row: its id, a hash of its text, the number of its different shingles, its class (equal sets have equal numbers, null if empty)
    and its component, the smallest id reachable by links.

    A text is lower-cased in A-Z and parted at white space; a set is that of all runs of so many words, or of the whole
    text if it is shorter. Two rows are linked if their sets' Jaccard similarity is at least similarity. Null and empty
    texts have an empty set and are linked with nothing. Repeated rows are in one class. A null id is smaller than none:
    a row's component is the smallest id that isn't null, null if there is no other. Other columns are ignored.
    """
    num, den = round(similarity * 100), 100
    rarity = shingle_counts(docs, text_col, words)
    chunks, buckets = counts(sized(docs, text_col), chunk_bytes, bucket_bytes)
    rows = chunked(docs, {"text": F.col(text_col).cast("string")}, [F.col(id_col), F.col(text_col).cast("string")], chunks)
    blob = "bucket int, chunk int, payload binary"
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def make(table: pa.Table) -> Sets:
        return Sets(table, words, shared.value, num, den)

    def first(table: pa.Table) -> pa.Table:
        return send_tokens(make, buckets, table)

    def second(table: pa.Table) -> pa.Table:
        return answer_tokens(table)

    def one(table: pa.Table, replies: pa.Table) -> pa.Table:
        return send_prefixes(make, num, den, buckets, table, replies)

    def two(table: pa.Table) -> pa.Table:
        return find_visits(num, den, block, table)

    def three(table: pa.Table, replies: pa.Table) -> pa.Table:
        return send_sets(make, num, den, buckets, table, replies)

    def four(table: pa.Table) -> pa.Table:
        return find_links(num, den, table)

    def describe(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                n, number = classes_of(*shingle_sets(part.column(1), words), len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(number, mask=n == 0)], names=["doc_id", "text_hash", "n_shingles", "class_id"])

    by_chunk = rows.groupBy("chunk")
    shared_tokens = by_chunk.applyInArrow(first, blob).groupBy("bucket").applyInArrow(second, blob)
    visits = by_chunk.cogroup(shared_tokens.groupBy("chunk")).applyInArrow(one, blob).groupBy("bucket").applyInArrow(two, blob)
    links = by_chunk.cogroup(visits.groupBy("chunk")).applyInArrow(three, blob).groupBy("bucket").applyInArrow(four, "a long, b long")
    found = components(links)
    each = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).mapInArrow(describe, "doc_id long, text_hash long, n_shingles long, class_id long"))
    least = each.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("least"))
    least = least.join(found, least.class_id == found.node, "left").select("class_id", "least", F.coalesce("component", "class_id").alias("component"))
    # written, so that both sides of the join are dealt for it and a hot component can be split
    whole = checkpointed(least.groupBy("component").agg(F.min("least").alias("component_id")))
    known = least.join(whole, "component").select("class_id", "component_id")
    return each.join(known, "class_id", "left").select("doc_id", "text_hash", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"))
