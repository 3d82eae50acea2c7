"""Common prefixes from a Burrows-Wheeler transform by threshold-bounded interval expansion (after Beller, Gog, Ohlebusch and Schnattinger, 2011).

The intervals of strings in the sorted suffixes are extended backward, by one byte in front, breadth
first. The first interval of a string of length l + 1 that ends before place i tells that the common
prefix at i has l bytes; so values come in increasing order, and the expansion stops at the least
length that matters: what has no value by then is at least as long.
"""

from __future__ import annotations

import numpy as np

from .words import ragged

END = 255  # not a byte of UTF-8


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` bytes at least: prefix doubling from eight bytes on, in which only suffixes that are not yet alone are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, END, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank = np.empty(n + 1, np.int64)  # a rank is the first place of its group
    rank[n] = -1
    start = np.flatnonzero(new)
    rank[order] = start[np.cumsum(new) - 1]
    width = 8
    while width < depth:
        # groups of more than one
        size = np.diff(np.append(start, n))
        many = size > 1
        if not many.any():
            break
        at = ragged(start[many], size[many])
        own = order[at]
        key = (rank[own] << 32) + rank[np.minimum(own + width, n)] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[at] = own
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = at[np.flatnonzero(new)]
        rank[own] = begin[np.cumsum(new) - 1]
        start = np.sort(np.concatenate([start[~many], begin]))
        width *= 2
    return order


def unset_from(bwt: np.ndarray, limit: int) -> np.ndarray:
    """For places 0 .. n: whether the common prefix of the suffixes at i - 1 and i has ``limit`` bytes or more."""
    n = len(bwt)
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(limit):
        size = high - low
        at = ragged(low, size)
        source = np.repeat(np.arange(len(low)), size)
        stay = bwt[at] != END
        at, source = at[stay], source[stay]
        if not len(at):
            break
        # the steps of one interval with one byte are successive places
        char = bwt[at]
        to = lf[at]
        order = np.argsort(to)
        to, source, char = to[order], source[order], char[order]
        cut = np.flatnonzero((source[1:] != source[:-1]) | (char[1:] != char[:-1])) + 1
        low, high = to[np.concatenate(([0], cut))], to[np.append(cut, len(to)) - 1] + 1
        new = unset[high] | (high == n)
        # the interval that ends at n sets nothing, but goes on as long as it is the last of its length
        low, high = low[new], high[new]
        unset[high] = False
        if not len(low):
            break
    return unset


def repeated(segments: list[bytes], weights: np.ndarray, limit: int) -> list[np.ndarray]:
    """For each segment, by start: whether the ``limit`` bytes from there are anywhere else, in it or another one; a segment of a weight over 1 stands for several."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(bytes([END]).join(segments) + bytes([END]), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    order = suffix_order(text, limit)
    unset = unset_from(text[order - 1], limit)
    flag = np.zeros(len(text), bool)
    flag[order] = unset[:-1] | unset[1:]
    return [flag[a : a + max(0, n - limit + 1)] | (w > 1) for a, n, w in zip(first.tolist(), sizes.tolist(), weights.tolist(), strict=True)]
