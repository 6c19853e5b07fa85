"""What slices of a list tell, for many slices at once: their work is that of the list and of their number, not of what they hold."""

from __future__ import annotations

import numpy as np


def pieces(a: np.ndarray, b: np.ndarray):
    """The nodes of a tree of pairs that make up each slice, level by level: (slices, their node at the left end, slices, their node at the right)."""
    while True:
        left, right = np.flatnonzero((a < b) & (a % 2 == 1)), np.flatnonzero((a < b) & (b % 2 == 1))
        yield left, a[left], right, b[right] - 1
        a, b = (a + 1) // 2, b // 2
        if not (a < b).any():
            return


def _merge(x: tuple, y: tuple) -> tuple:
    """(rows, sum, squares around the mean, least, greatest) of two lists put together."""
    (n, s, q, lo, hi), (m, t, p, lo2, hi2) = x, y
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.where((n > 0) & (m > 0), t / np.maximum(m, 1) - s / np.maximum(n, 1), 0.0)
        return n + m, s + t, q + p + gap * gap * (n * m / np.maximum(n + m, 1)), np.fmin(lo, lo2), np.where(n == 0, hi2, np.where(m == 0, hi, np.maximum(hi, hi2)))


def moments(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """Rows, sum, squares around the mean, least and greatest value of x[a:b]: nothing outside of a slice is added and taken off again."""
    none = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a)), np.full(len(a), np.nan), np.full(len(a), np.nan)
    with np.errstate(invalid="ignore"):
        out, level = none, (np.ones(len(x)), x, x * 0.0, x, x)
    for left, i, right, j in pieces(a, b):
        for those, at in ((left, i), (right, j)):
            if len(those):
                for o, v in zip(out, _merge(tuple(o[those] for o in out), tuple(v[at] for v in level))):
                    o[those] = v
        if len(level[0]) % 2:
            level = tuple(np.r_[v, v0] for v, v0 in zip(level, (0.0, 0.0, 0.0, np.nan, np.nan)))
        level = _merge(tuple(v[::2] for v in level), tuple(v[1::2] for v in level))
    return out


def below(codes: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of codes[a:b] are under the slice's limit, told bit by bit (a wavelet tree, of which one level is held)."""
    out = np.zeros(len(a), np.int64)
    for bit in reversed(range(int(max(codes.max(initial=0), limit.max(initial=0))).bit_length())):
        zero = codes >> bit & 1 == 0
        before = np.r_[0, np.cumsum(zero)]
        za, zb, one = before[a], before[b], limit >> bit & 1 == 1
        out += np.where(one, zb - za, 0)
        a, b = np.where(one, before[-1] + a - za, za), np.where(one, before[-1] + b - zb, zb)
        codes = np.r_[codes[zero], codes[~zero]]
    return out


def different(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many different codes codes[a:b] has: those that were last seen before it."""
    order = np.argsort(codes, kind="stable")
    was = np.zeros(len(codes), np.int64)  # one more than the place before
    same = codes[order[1:]] == codes[order[:-1]]
    was[order[1:]] = np.where(same, order[:-1] + 1, 0)
    return below(was, a, b, a + 1)


def kth(codes: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th (slice, …) from 0 of the codes in codes[a:b]."""
    out = np.zeros(k.shape, np.int64)
    a, b = (np.broadcast_to(x[:, None], k.shape) for x in (a, b))
    for bit in reversed(range(int(codes.max(initial=0)).bit_length())):
        zero = codes >> bit & 1 == 0
        before = np.r_[0, np.cumsum(zero)]
        za, zb = before[a], before[b]
        left = k < zb - za
        out += np.where(left, 0, 1 << bit)
        k = np.where(left, k, k - (zb - za))
        a, b = np.where(left, za, before[-1] + a - za), np.where(left, zb, before[-1] + b - zb)
        codes = np.r_[codes[zero], codes[~zero]]
    return out
