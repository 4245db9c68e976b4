"""Interval expansion on a Burrows-Wheeler transform, bounded by a threshold."""

from __future__ import annotations

import numpy as np

DEPTH = 50


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Positions of x (bytes, taken as a ring) in the order of the 50 bytes from there on; fewer than 2**24 positions."""
    n = len(x)
    ring = np.resize(x, n + 64) if n < 64 else np.concatenate((x, x[:64]))
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = eight << np.uint64(8) | ring[j : j + n]
    at = np.arange(n)

    def ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([False], key[order[1:]] != key[order[:-1]])))
        return rank

    r8 = ranks(eight)
    r16 = ranks(r8 << np.uint64(24) | r8[(at + 8) % n])
    r32 = ranks(r16 << np.uint64(24) | r16[(at + 16) % n])
    two = ring[48 : 48 + n].astype(np.uint64) << np.uint64(8) | ring[49 : 49 + n]
    return np.argsort(r32 << np.uint64(40) | r16[(at + 32) % n] << np.uint64(16) | two)


def expand(bwt: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """starts[i]: the suffixes i - 1 and i have fewer than `depth` bytes in common (n + 1 entries).

    Breadth first: an interval of the suffixes that begin with w is extended backward to those of cw, for
    each byte c in the transform there. Where cw's interval ends at a place that has no value yet, the
    common prefix there is as long as w, and cw is extended in the next round. So values come in
    increasing order, each place once, and the search stops at `depth`.
    """
    n = len(bwt)
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    starts = np.zeros(n + 1, bool)
    starts[[0, n]] = True
    heads = np.zeros(n + 1, bool)  # where the suffixes' first byte changes
    heads[np.cumsum(np.bincount(bwt, minlength=256))] = True
    low, high = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n - 1, np.int64)
    for _ in range(depth):
        if not len(low):
            break
        sizes = high - low + 1
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes - low, sizes)
        of = np.repeat(np.arange(len(low)), sizes)
        # one sort deals the extended suffixes to their intervals: by place, with the interval that they come from
        key = np.sort(lf[at] << 24 | of)
        place, of = key >> 24, key & 0xFFFFFF
        last = np.concatenate(((np.diff(of) != 0) | (np.diff(place) != 1) | heads[place[1:]], [True]))
        first = np.concatenate(([True], last[:-1]))
        low, high = place[first], place[last]
        new = ~starts[high + 1]
        low, high = low[new], high[new]
        starts[high + 1] = True
    return starts


def common_prefix_groups(x: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes in order, and numbers of the groups whose members agree in `depth` bytes."""
    order = suffix_order(x)
    starts = expand(x[order - 1], depth)
    return order, np.cumsum(starts[:-1]) - 1
