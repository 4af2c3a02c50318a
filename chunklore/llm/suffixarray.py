"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Suffixes are classified, the leftmost-smaller (LMS) substrings are sorted by one induction and named, the names are ordered by recursion, and a second
induction orders all suffixes. An induction goes through the buckets of the first symbol once from each side, as many buckets at a time as
induce nothing into each other: with a large alphabet, as names are, these are many, with bytes few. What a bucket induces into itself are runs of its symbol, which are put in place at
once. So every suffix is moved once a pass.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S: a suffix smaller than the next one. The last suffix is L, as the empty one is smaller."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    s = np.zeros(n, bool)
    if len(differs):
        nearest = np.searchsorted(differs, np.arange(differs[-1] + 1))
        s[: differs[-1] + 1] = (t[:-1] < t[1:])[differs][nearest]
    return s


def _runs(t: np.ndarray) -> np.ndarray:
    """How many equal symbols stand right before each place."""
    place = np.arange(len(t))
    return place - np.maximum.accumulate(np.where(np.append(True, t[1:] != t[:-1])[: len(t)], place, 0))


def _chain(seeds: np.ndarray, run: np.ndarray) -> np.ndarray:
    """What the seeds, in their order, induce into their own bucket: the places before them in runs of its symbol, nearest first."""
    r = run[seeds]
    step = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r) + 1
    return (np.repeat(seeds, r) - step)[np.argsort(step, kind="stable")]


def _grouped(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the rank of each within its own, the buckets, and how many each gets."""
    order = np.argsort(to, kind="stable")
    ordered = to[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(to)])
    many = np.diff(np.append(first, len(to)))
    return order, np.arange(len(to)) - np.repeat(first, many), ordered[first], many


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: np.ndarray, run: np.ndarray) -> np.ndarray:
    """All suffixes from LMS suffixes in the order given: ordered by them. size: of each symbol's bucket; run: _runs(t)."""
    n, end = len(t), np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    present = np.flatnonzero(size)
    lms = lms[np.argsort(t[lms], kind="stable")]
    lms_at = np.searchsorted(t[lms], np.arange(len(size) + 1))

    # L suffixes, from the smallest bucket up; of a bucket the L ones come before the LMS ones
    head = begin.copy()

    def put_large(p: np.ndarray) -> None:
        if len(p):
            order, rank, to, many = _grouped(t[p])
            sa[np.repeat(head[to], many) + rank] = p[order]
            head[to] += many

    put_large(np.array([n - 1]))  # the empty suffix, smallest of all, induces the last one
    k, width = 0, 1
    while k < len(present):
        stop = min(k + width, len(present))
        c, last = present[k], present[stop - 1]
        large, small = sa[begin[c] : end[last]], lms[lms_at[c] : lms_at[last + 1]]
        large = large[large >= 0]
        e = np.concatenate([large, small])
        if stop - k > 1:
            e = e[np.argsort(2 * t[e] + (np.arange(len(e)) >= len(large)), kind="stable")]
        e = e[e > 0]
        e = e[~s[e - 1]]
        p = e - 1
        to = t[p]
        inside = to <= last
        if not inside.any():
            put_large(p)
            k, width = stop, min(2 * width, 1 << 14)
            continue
        least = to[inside].min()
        if least > c:  # buckets before that one are whole
            put_large(p[t[e] < least])
            k, width = int(np.searchsorted(present, least)), max(1, width // 2)
            continue
        chain = _chain(sa[begin[c] : head[c]], run)
        sa[head[c] : head[c] + len(chain)] = chain
        head[c] += len(chain)
        e = np.concatenate([sa[begin[c] : head[c]], lms[lms_at[c] : lms_at[c + 1]]])
        p = e[e > 0] - 1
        put_large(p[~s[p] & (t[p] != c)])
        k, width = k + 1, max(1, width // 2)

    # S suffixes, from the largest bucket down; of a bucket the S ones come before, from above, the L ones
    tail = end.copy()

    def put_small(p: np.ndarray) -> None:
        if len(p):
            order, rank, to, many = _grouped(t[p])
            sa[np.repeat(tail[to], many) - 1 - rank] = p[order]
            tail[to] -= many

    k, width = len(present) - 1, 1
    while k >= 0:
        stop = max(k - width + 1, 0)
        c, last = present[k], present[stop]
        e = sa[begin[last] : end[c]]
        e = e[e > 0][::-1]
        e = e[s[e - 1]]
        p = e - 1
        to = t[p]
        inside = to >= last
        if not inside.any():
            put_small(p)
            k, width = stop - 1, min(2 * width, 1 << 14)
            continue
        most = to[inside].max()
        if most < c:
            put_small(p[t[e] > most])
            k, width = int(np.searchsorted(present, most)), max(1, width // 2)
            continue
        chain = _chain(sa[tail[c] : end[c]][::-1], run)
        sa[tail[c] - len(chain) : tail[c]] = chain[::-1]
        tail[c] -= len(chain)
        e = sa[begin[c] : end[c]]
        p = e[e > 0][::-1] - 1
        put_small(p[s[p] & (t[p] != c)])
        k, width = k - 1, max(1, width // 2)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of the suffixes of t (small non-negative integers) in order; a prefix comes before what it is a prefix of."""
    t = np.asarray(t, dtype=np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    s, run = classify(t), _runs(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    size = np.bincount(t)
    sa = _induce(t, s, lms, size, run)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]  # LMS substrings in order
    length = np.empty(n, np.int64)
    length[lms] = np.append(np.diff(lms), n - lms[-1]) + 1  # up to the next LMS suffix, its first byte included
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    padded, kind = np.append(t, -1), np.append(s, False)
    live, k = np.flatnonzero(same), 0
    while len(live):  # compared byte by byte and class by class, all at once, until they end
        x, y = a[live] + k, b[live] + k
        equal = (padded[x] == padded[y]) & (kind[x] == kind[y])
        same[live[~equal]] = False
        k += 1
        live = live[equal & (k < length[a[live]])]
    names = np.empty(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    most = int(reduced.max()) + 1
    ranked = np.argsort(reduced) if most == len(lms) else suffix_array(reduced)
    return _induce(t, s, lms[ranked], size, run)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place in t the common prefix with the suffix before it in order. Only where the preceding bytes differ are bytes compared;
    elsewhere it is the previous place's less one."""
    t = np.asarray(t)
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = (phi > 0) & (place > 0)
    reducible[reducible] = t[place[reducible] - 1] == t[phi[reducible] - 1]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    k = 0
    while len(live):
        live = live[np.maximum(live, phi[live]) + k < n]
        live = live[t[live + k] == t[phi[live] + k]]
        out[live] += 1
        k += 1
    base = np.maximum.accumulate(np.where(reducible, -1, place))
    return np.where(reducible, out[base] - (place - base), out)
