"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

A level with a small alphabet induces one bucket at a time: all suffixes of a
bucket place their predecessors in one step, with further rounds only for runs
of the bucket's own character. A level with a large alphabet (the names of
leftmost-smaller substrings) induces suffix by suffix over lists.
"""

from __future__ import annotations

import numpy as np

SMALL = 2048  # alphabet up to which buckets are induced as arrays


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True at S-type positions: the suffix is smaller than the next one. The last position is S-type."""
    n = len(s)
    rise = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(rise != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(rise, 1)[np.minimum(at, n - 1)] > 0
    return out


def _induce(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes (or substrings) in order."""
    n, k = len(s), len(size)
    end = np.cumsum(size)
    head, sa = end - size, np.full(n, -1, np.int64)
    lms_from = np.concatenate([[0], np.cumsum(np.bincount(s[lms], minlength=k))])
    put = head.copy()

    def spread(source: np.ndarray, c: int, larger: bool) -> None:
        p = source[source > 0] - 1
        p = p[(stype[p] != larger) & ((s[p] > c) if larger else (s[p] < c))]
        if not len(p):
            return
        d = s[p]
        order = np.argsort(d, kind="stable")
        p, d = p[order], d[order]
        first = np.concatenate([[True], d[1:] != d[:-1]])
        begin = np.flatnonzero(first)
        rank = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
        if larger:
            sa[put[d] + rank] = p
            put[d[begin]] += np.diff(np.append(begin, len(d)))
        else:
            sa[put[d] - 1 - rank] = p
            put[d[begin]] -= np.diff(np.append(begin, len(d)))

    used = np.flatnonzero(size)
    for c in used:
        a = head[c]
        while a < put[c]:
            b = put[c]
            p = sa[a:b]
            p = p[p > 0] - 1
            p = p[~stype[p] & (s[p] == c)]
            sa[b : b + len(p)] = p
            put[c] += len(p)
            a = b
        spread(np.concatenate([sa[head[c] : put[c]], lms[lms_from[c] : lms_from[c + 1]]]), c, True)
    l_end, put = put, end.copy()
    for c in used[::-1]:
        b = end[c]
        while put[c] < b:
            a = put[c]
            p = sa[a:b][::-1]
            p = p[p > 0] - 1
            p = p[stype[p] & (s[p] == c)]
            sa[a - len(p) : a] = p[::-1]
            put[c] -= len(p)
            b = a
            if not len(p):
                break
        # S-type suffixes that begin a run of c come from larger buckets, or are the end of the text
        spread(np.concatenate([sa[put[c] : end[c]][::-1], sa[head[c] : l_end[c]][::-1]]), c, False)
    sa[0] = n - 1
    return sa


def _names(s: np.ndarray, lms_sorted: np.ndarray, lms_text: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order; equal substrings share one."""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[lms_text] = np.append(np.diff(lms_text), 0) + 1
    a, b = lms_sorted[:-1], lms_sorted[1:]
    same = length[a] == length[b]
    at, j = np.flatnonzero(same), 0
    while len(at):
        differ = s[a[at] + j] != s[b[at] + j]
        same[at[differ]] = False
        at = at[~differ]
        j += 1
        at = at[length[a[at]] > j]
    name = np.concatenate([[0], np.cumsum(~same)])
    by_place = np.zeros(n, np.int64)
    by_place[lms_sorted] = name
    return by_place[lms_text], int(name[-1]) + 1


def _by_lists(s: list[int], k: int) -> list[int]:
    """Induced sorting suffix by suffix; s ends in its only, smallest 0."""
    n = len(s)
    if n == 1:
        return [0]
    t = bytearray(n)
    t[n - 1] = 1
    for i in range(n - 2, -1, -1):
        t[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and t[i + 1])
    size = [0] * k
    for c in s:
        size[c] += 1
    ends, total = [], 0
    for x in size:
        total += x
        ends.append(total)
    lms = [i for i in range(1, n) if t[i] and not t[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa, tail = [-1] * n, ends[:]
        for i in reversed(order):
            tail[s[i]] -= 1
            sa[tail[s[i]]] = i
        head = [e - x for e, x in zip(ends, size)]
        for x in range(n):
            j = sa[x] - 1
            if j >= 0 and not t[j]:
                c = s[j]
                sa[head[c]] = j
                head[c] += 1
        tail = ends[:]
        for x in range(n - 1, -1, -1):
            j = sa[x] - 1
            if j >= 0 and t[j]:
                c = s[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    sa, is_lms = induce(lms), bytearray(n)
    for i in lms:
        is_lms[i] = 1
    stop = dict(zip(lms, lms[1:] + [n - 1]))
    name, names, before = {}, -1, None
    for i in sa:
        if is_lms[i]:
            if before is None or s[i : stop[i] + 1] != s[before : stop[before] + 1]:
                names += 1
            name[i], before = names, i
    reduced = [name[i] for i in lms]
    if names + 1 == len(lms):
        order = [0] * len(lms)
        for x, c in enumerate(reduced):
            order[c] = x
    else:
        order = _by_lists(reduced, names + 1)
    return induce([lms[x] for x in order])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order; s must end in its only, smallest value 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(s.max()) + 1
    if k > SMALL:
        return np.array(_by_lists(s.tolist(), k), np.int64)
    s = s.astype(np.int16)
    stype, size = smaller_types(s), np.bincount(s, minlength=k)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    by_char = lms[np.argsort(s[lms], kind="stable")]
    sa = _induce(s, stype, by_char, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    reduced, names = _names(s, sa[is_lms[sa]], lms)
    order = np.argsort(reduced, kind="stable") if names == len(lms) else suffix_array(reduced)
    return _induce(s, stype, lms[order], size)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PLCP and Phi by place: the common prefix with the suffix before it in order, and which that is (-1: none).

    Only irreducible values are compared; the others are one less than their left neighbour's.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    left, before = s[np.maximum(place - 1, 0)], s[np.maximum(phi - 1, 0)]
    head = np.flatnonzero((place == 0) | (phi <= 0) | (left != before))
    value = np.zeros(len(head), np.int64)
    at = np.flatnonzero(phi[head] >= 0)
    step = np.arange(16)
    padded = np.concatenate([s, np.full(16, -1, s.dtype)])
    while len(at):
        a, b = head[at] + value[at], phi[head[at]] + value[at]
        same = padded[np.minimum(a[:, None] + step, n + 15)] == padded[np.minimum(b[:, None] + step, n + 15)]
        same[(a >= n) | (b >= n)] = False
        run = np.where(same.all(axis=1), 16, (~same).argmax(axis=1))
        value[at] += run
        at = at[run == 16]
    which = np.zeros(n, np.int64)
    which[head[1:]] = 1
    which = np.cumsum(which)
    return np.maximum(value[which] - (place - head[which]), 0), phi
