"""Words of whole Arrow text columns as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are never
decoded: word boundaries come from a byte table and each word gets a 64-bit
hash, all in array operations whose temporaries are bounded by SPAN bytes. Words of over LONG bytes are hashed by blake2b: a polynomial
modulo 2^64 can't tell some long words apart (Thue-Morse words).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, and bytes of a word that the polynomial hash takes.
SPAN, LONG = 1 << 20, 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: Odd multipliers for the places in an n-gram.
_PLACE = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        one = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            one.append(np.multiply.accumulate(p))
        if n > 2 * SPAN:
            return one[0], one[1]  # for one long text only; not kept
        _powers = one[0], one[1]
    return _powers


#: glibc's malloc_trim, where there is one: what numpy has freed goes back to the system.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: What a worker keeps from task to task, by the operator that made it.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What earlier tasks of an operator left in this worker. What other operators left is dropped, and unused memory goes back to the system."""
    others = [k for k in _kept if k != operator]
    for other in others:
        del _kept[other]
    if others:
        gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    if _trim:
        _trim(0)
    return _kept.setdefault(operator, {})


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def spans(offsets: np.ndarray, limit: int = SPAN) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of the rows lo..hi: byte range start..end of each word within buf; row i has the words first[i]..first[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE):
        buf = data[offsets[0] : offsets[-1]]
        self.buf = LOWER[buf] if lower else buf
        at = offsets - offsets[0]
        kind = np.int32 if len(buf) < 1 << 31 else np.int64
        edges = np.unique(at[1:][at[1:] > at[:-1]])  # where texts end
        starts, ends = [], []
        for lo in range(0, len(buf), SPAN):  # a text of any length, with temporaries of a part of it
            hi = min(len(buf), lo + SPAN)
            solid = np.zeros(hi - lo + 2, bool)  # with a byte on either side
            a, b = max(0, lo - 1), min(len(buf), hi + 1)
            solid[a - lo + 1 : b - lo + 1] = ~gaps[buf[a:b]]
            before, after = solid[:-2].copy(), solid[2:].copy()
            edge = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi, "right")] - lo
            before[edge[edge < hi - lo]] = False
            after[edge[edge > 0] - 1] = False
            starts.append((np.flatnonzero(solid[1:-1] & ~before) + lo).astype(kind))
            ends.append((np.flatnonzero(solid[1:-1] & ~after) + lo + 1).astype(kind))
        none = np.zeros(0, kind)
        self.start = np.concatenate(starts) if starts else none
        del starts
        self.end = np.concatenate(ends) if ends else none
        self.first = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):
            base = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, base + SPAN, "right")))
            if self.end[lo] - base > SPAN:  # one word, below
                lo = hi
                continue
            part = self.buf[base : self.end[hi - 1]]
            up, down = _power(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            lo = hi
        for lo in range(0, len(out), SPAN):
            out[lo : lo + SPAN] = mix(out[lo : lo + SPAN])
        for k in np.flatnonzero(self.end - self.start > LONG).tolist():
            out[k] = int.from_bytes(blake2b(self.buf[self.start[k] : self.end[k]], digest_size=8).digest(), "little")
        return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each start (across rows too)."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for lo in range(0, size, SPAN):
        part = out[lo : lo + SPAN]
        for k in range(n):
            part += h[lo + k : lo + k + len(part)] * _PLACE[k]
        out[lo : lo + SPAN] = mix(part)
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(column, n: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row its set of n-word shingles as sorted hashes: with fewer words the whole sequence is one, without words there is none."""
    data, at = raw(column)
    for lo, hi in spans(at):
        w = Words(data, at[lo : hi + 1], lower)
        first, h = w.first, w.hashes()
        del w
        if hi - lo == 1 and len(h) > SPAN:
            h = grams(h, n)
            h.sort()
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
            continue
        g = grams(h, n)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                yield distinct(g[a : b - n + 1])
            elif b > a:
                yield grams(h[a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield h[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
