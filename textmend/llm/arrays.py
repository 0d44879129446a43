"""Numpy kernels over the bytes and words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
U = np.uint64
_POWERS: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _POWERS.get("p")
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS["p"] = tuple(out)
    return have[0][:n], have[1][:n]


def rising(n: int) -> np.ndarray:
    """BASE**i modulo 2**64 for i < n."""
    have = _POWERS.get("r")
    if have is None or len(have) < n:
        have = np.full(max(1 << 12, n), BASE, U)
        have[0] = 1
        have = _POWERS["r"] = np.multiply.accumulate(have)
    return have[:n]


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    if "t" not in _POWERS:
        _POWERS["t"] = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    return _POWERS["t"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(32)
    return h


def joined(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a newline, with the first and the end of each; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    col = pc.binary_join_element_wise(col, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    return data, off[:-1].copy(), off[1:] - 1


def spaces() -> np.ndarray:
    """Marks space and the bytes 9 to 13."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of bytes that aren't white space; data ends with white space."""
    space = spaces()[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial hash of data[first:end] for each span; spans are in order and don't overlap."""
    out = np.empty(len(first), U)
    values, at = byte_values(), 0
    while at < len(first):
        lo = int(first[at])
        to = max(at + 1, int(np.searchsorted(end, lo + block, "right")))
        hi = int(end[to - 1])
        pw, inv = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(values[data[lo:hi]] * pw[: hi - lo], out=total[1:])
        a, b = first[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((total[b] - total[a]) * inv[a] + (b - a).astype(U))
        at = to
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z become a to z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for count steps, for each pair, in a row."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(np.asarray(first, np.int64), count)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys starts in sorted arrays, as a mask."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def planes(a: np.ndarray, width: int) -> bytes:
    """The low width bytes of each number, byte by byte, so that high zero bytes lie together."""
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T).tobytes()


def unplanes(raw, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(U).reshape(n)


def pieces(batch, column: int, size: int = 1 << 20):
    """Slices of the batch with about size bytes in a text column, one row at least."""
    n = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 1)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def total(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of x[first:end]."""
    c = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=c[1:])
    return c[end] - c[first]


def lean() -> None:
    """Large arrays go back to the system as soon as they are freed; else each of an executor's workers keeps its peak."""
    if "lean" not in _POWERS:
        import ctypes

        _POWERS["lean"] = True
        try:
            malloc = ctypes.CDLL(None).mallopt
        except (OSError, AttributeError):  # another C library
            return
        pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool keeps what it had
        pa.set_cpu_count(1)
        malloc(-8, 1)  # M_ARENA_MAX
        malloc(-3, 1 << 22)  # M_MMAP_THRESHOLD
        malloc(-1, 1 << 24)  # M_TRIM_THRESHOLD
