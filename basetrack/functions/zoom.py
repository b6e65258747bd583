"""Greedy zoom records on arrays: a record absorbs the intervals that start within ``size`` of its own start."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Records(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    bases: np.ndarray
    least: np.ndarray
    most: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @staticmethod
    def of(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> Records:
        n, v = (ends - starts).astype(np.int64), values.astype(np.float64)
        return Records(starts.astype(np.int64), ends.astype(np.int64), n, v, v, n * v, n * v * v)

    def part(self, at: slice) -> Records:
        return Records(*(c[at] for c in self))


_HOW = (np.minimum, np.maximum, np.add, np.minimum, np.maximum, np.add, np.add)


def _reduced(r: Records, cuts: list[int]) -> Records:
    return Records(*(how.reduceat(c, cuts) for how, c in zip(_HOW, r, strict=True)))


def zoom_sizes(mean_width: float, longest: int, most: int = 10) -> list[int]:
    """Reduction sizes: 16 mean widths, at least 10, then four times the one before up to the longest chromosome."""
    out, size = [], max(10, int(16 * mean_width))
    while len(out) < most and size <= longest:
        out.append(size)
        size *= 4
    return out


class Greedy:
    """Takes intervals or finer records in order, of one key after another; gives out records that are complete."""

    def __init__(self, size: int) -> None:
        self.size, self.key, self.open = size, None, None

    def feed(self, key: object, r: Records) -> list[tuple[object, Records]]:
        out = []
        if self.open is not None and key != self.key:
            out += self.close()
        self.key, n, at = key, len(r.start), 0
        if self.open is not None and n:
            at = int(np.searchsorted(r.start, self.open.start[0] + self.size))
            if at:
                self.open = _reduced(Records(*(np.concatenate([a, b[:at]]) for a, b in zip(self.open, r, strict=True))), [0])
        cuts = []
        while at < n:
            cuts.append(at)
            at = int(np.searchsorted(r.start, r.start[at] + self.size))
        if cuts:
            if self.open is not None:
                out.append((key, self.open))
            made = _reduced(r, cuts)
            if len(cuts) > 1:
                out.append((key, made.part(slice(0, -1))))
            self.open = made.part(slice(-1, None))
        return out

    def close(self) -> list[tuple[object, Records]]:
        out = [] if self.open is None else [(self.key, self.open)]
        self.open = None
        return out
