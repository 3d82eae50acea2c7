"""Words of Arrow text batches as numpy arrays: where they are and a 64-bit hash of each, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import flat, mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = True
STOPS = np.zeros(256, bool)
STOPS[[44, 46]] = True

P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i, modulo 2**64, for i below n."""
    if len(_pow[0]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            for k, p in enumerate((P, P_INV)):
                a = np.full(size, p, np.uint64)
                a[0] = 1
                _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow[0][:n], _pow[1][:n]


@dataclass
class Words:
    """The words of some documents of a batch. Documents first .. first + n - 1; the words of document i of these are cut[i] .. cut[i+1]."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    cut: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.cut)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.count)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def _words(data: np.ndarray, offsets: np.ndarray, first: int, lower: bool, stops: bool) -> Words:
    n = len(data)
    if lower:
        data = LOWER[data]
    here = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a document begins
    edge[offsets] = True
    edge = edge[:n]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = here[:-1]
    begin = here & (~before | edge)
    if stops and n:
        after = np.empty(n, bool)  # white space or the end of a document follows
        after[-1] = True
        after[:-1] = ~here[1:] | edge[1:]
        letter = np.zeros(n, bool)
        letter[1:] = LETTER[data[:-1]] & ~edge[1:]
        begin |= STOPS[data] & after & letter
    start = np.flatnonzero(begin)
    # a word ends where the next one begins or white space follows
    last = here.copy()
    last[:-1] &= ~here[1:] | begin[1:]
    end = np.flatnonzero(last) + 1
    power, inverse = powers(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(first, len(offsets) - 1, data, offsets, start, end, mix(h), np.searchsorted(start, offsets))


def words(col: pa.Array, lower: bool = False, stops: bool = False, size: int = 1 << 18) -> Iterator[Words]:
    """Chunks of about ``size`` bytes, whole documents each. ``stops``: a lone point or comma after an ASCII
    letter and before white space is a word of its own."""
    data, offsets = flat(col)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, lower, stops)
        a = b


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] times, then start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)
