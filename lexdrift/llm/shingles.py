"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np

from .common import distinct, mix64
from .components import union

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9FB21C651E98DF25 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, ASCII letters in lower case, and the first word of each row (and the number of all)."""
    rows = len(offsets) - 1
    text = np.full(len(data) + rows + 1, 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(rows) + 1, np.diff(offsets))] = _LOWER[data]
    space = _SPACE[text]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _power(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _FACTORS[0])
    first = np.searchsorted(starts, offsets + np.arange(rows + 1))
    return h, first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted; with fewer words, the whole sequence is the only one, without words there is none."""
    h, first = word_hashes(data, offsets)
    n = len(h) - words + 1
    if n > 0:
        all_ = h[:n] * _FACTORS[0]
        for k in range(1, words):
            all_ += h[k : n + k] * _FACTORS[k % 8]
        all_ = mix64(all_)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(distinct(all_[a : b - words + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many items each of the sets at `left` shares with each at `right`, exactly: products of 0/1 matrices, some columns at a time."""
    n = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    order = np.argsort(items)
    items = items[order]
    same = items[1:] == items[:-1]
    some = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # what one set alone has goes
    fresh = np.concatenate([[True], ~same])[some]
    col = np.cumsum(fresh) - 1
    row = np.repeat(np.arange(len(sets)), n)[order][some]
    out = np.zeros((len(left), len(right)))
    step = max(64, (1 << 21) // len(sets))
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, (c, c + step))
        x = np.zeros((len(sets), min(step, int(col[-1]) + 1 - c)), np.float32)
        x[row[a:b], col[a:b] - c] = 1
        out += x[left] @ x[right].T
    return out


def links_within(sets: list[np.ndarray], percent: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets (positions) by exact Jaccard similarity, enough to connect all that are connected; of sides 1 and 2 only across."""
    left, right = (np.arange(len(sets)),) * 2 if not side[0] else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        inter = np.array([[len(np.intersect1d(sets[0], sets[1], assume_unique=True))]])
        left, right = np.array([0]), np.array([1])
    else:
        inter = shared(sets, left, right)
    hit = 100 * inter >= percent * (n[left][:, None] + n[right][None] - inter)
    x, y = np.nonzero(hit)
    x, y = left[x], right[y]
    some = x != y
    x, y = x[some], y[some]
    if len(x) < len(sets):
        return x, y
    root = union(len(sets), x.tolist(), y.tolist())
    other = np.flatnonzero(root != np.arange(len(sets)))
    return root[other], other
