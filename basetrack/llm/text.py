"""Words and rolling hashes over whole Arrow text columns, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Its hash chains a finaliser over its 8-byte lanes; spans beyond
LANES * 8 bytes take BLAKE2.  Word hashes are then rolled: with a prefix sum P of ``hash * C^position`` modulo 2^64, the hash of any window is
``(P[end] - P[start]) * C^-start``, so one pass over the words serves every n-gram length.  (Rolling bytes alike would not do: a polynomial
modulo 2^64 collides on two-symbol strings of 1,024 symbols, whatever the base.  Windows are a few words of 64 mixed bits each.)
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = (1 << 64) - 1
_B = 0x9E3779B97F4A7C15
_C = 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _M, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


#: 8-byte lanes of a span that are hashed side by side.
LANES = 8


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on, zeros after its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def _low_bytes(lane: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` bytes of lanes."""
    return lane & (np.uint64(_M) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(_B) + np.uint64(1))
    if not len(size):
        return out
    lanes = _lanes(data)
    short = size <= 8 * LANES
    at = np.flatnonzero(short & (size > 0))
    for k in range(LANES):
        if not len(at):
            break
        out[at] = mix((out[at] + np.uint64(_C)) ^ (_low_bytes(lanes[starts[at] + 8 * k], size[at] - 8 * k) * np.uint64(_B)))
        at = at[size[at] > 8 * (k + 1)]
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start : start + size] and b[start : start + size] are the same bytes, for each pair of spans."""
    out = np.ones(len(size), bool)
    left, right = _lanes(a), _lanes(b)
    at = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for k in range(LANES):
        if not len(at):
            break
        own = size[at] - 8 * k
        out[at] &= _low_bytes(left[a_starts[at] + 8 * k] ^ right[b_starts[at] + 8 * k], own) == 0
        at = at[own > 8]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        n = size[i]
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return out


def span_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of values[start:end] for each span of a few mixed values."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]


class Words(NamedTuple):
    data: np.ndarray  # the bytes of all rows
    bounds: np.ndarray  # of the rows in data, one more than rows
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray  # of each row's words, one more than rows
    hashes: np.ndarray  # of the words

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row bounds of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array) -> Words:
    data, bounds = column_bytes(column)
    n = len(data)
    ink = np.empty(n + 2, bool)
    ink[0] = ink[-1] = False
    ink[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)  # a row begins here
    cut[bounds] = True
    begins = ink[1:-1] & (~ink[:-2] | cut[:-1])
    stops = ink[1:-1] & (~ink[2:] | cut[1:])
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds), byte_hashes(data, starts, ends))


def window_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the row of each n-word window; windows stay within their row."""
    count = np.maximum(np.diff(first) - (n - 1), 0)
    rows = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][rows] + offset, rows


def window_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, row) of each n-word window."""
    at, rows = window_rows(w.first, n)
    return mix(span_hashes(w.hashes, _C, at, at + n) + np.uint64(n)), at, rows


def keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return hashes ^ mix((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def characters(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: those of data[a:b] are out[b] - out[a]."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
