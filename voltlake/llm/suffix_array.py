"""Suffix array of one shard by induced sorting, and its permuted longest common prefixes, in vectorised steps."""

from __future__ import annotations

import numpy as np


DIRECT = 1 << 17  # a sequence of names this short is sorted by doubling instead of another recursion


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the sorted length."""
    n, k = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of small integers whose last symbol is 0 and unique.

    Suffixes are classified, the leftmost S-type (LMS) substrings are sorted by induction and named, the sequence of names is sorted
    recursively, and all suffixes are induced from the sorted LMS suffixes.
    """
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    step = np.diff(t)
    turn = np.where(step != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    s = np.ones(n, dtype=bool)
    s[:-1] = np.append(step, -1)[turn] > 0  # a run takes the type of its end; before the last symbol all fall
    lms_flag = s.copy()
    lms_flag[1:] &= ~s[:-1]
    lms_flag[0] = False
    lms = np.flatnonzero(lms_flag)
    if len(lms) == 1:
        return _induce(t, s, lms)
    order = _induce(t, s, lms)
    order = order[lms_flag[order]]
    names = _names(t, lms, order)
    if names[-1] + 1 < len(lms):
        place = np.empty(n, dtype=np.int64)
        place[order] = names
        reduced = place[lms]
        order = lms[_doubled(reduced) if len(reduced) <= DIRECT else suffix_array(reduced)]
    return _induce(t, s, order)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in sorted order; equal substrings share one."""
    size = np.empty(len(t), dtype=np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    active, k = np.flatnonzero(same), 0
    while len(active):
        x, y = a[active], b[active]
        equal = t[x + k] == t[y + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal & (size[x] > k)]
    return np.concatenate([[0], np.cumsum(~same)])


def _placed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, rank of each within its symbol, the symbols and their counts."""
    o = np.argsort(c, kind="stable")
    cs = c[o]
    head = np.flatnonzero(np.append(True, cs[1:] != cs[:-1]))
    count = np.diff(np.append(head, len(cs)))
    return o, np.arange(len(cs)) - np.repeat(head, count), cs[head], count


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order induced from the LMS suffixes as given.

    The scans move over stretches that are already filled. What a stretch induces goes to free slots, which lie behind it, so a
    whole stretch is one vectorised step.
    """
    n, symbols = len(t), int(t.max()) + 1
    n_l = np.bincount(t[~s], minlength=symbols)
    n_s = np.bincount(t[s], minlength=symbols)
    n_m = np.bincount(t[lms], minlength=symbols)
    start = np.cumsum(n_l + n_m) - n_l - n_m
    held = np.full(int((n_l + n_m).sum()), -1, dtype=np.int64)
    o, rank, _, _ = _placed(t[lms])
    held[(start + n_l)[t[lms[o]]] + rank] = lms[o]
    free, p, width = start.copy(), 0, 256
    while p < len(held):
        part = held[p: p + width]
        empty = part < 0
        r = int(empty.argmax()) if empty.any() else len(part)
        width = min(1 << 16, 2 * width) if r == len(part) else max(256, 2 * r)
        v = part[:r] - 1
        v = v[v >= 0]
        v = v[~s[v]]
        if len(v):
            c = t[v]
            o, rank, sym, count = _placed(c)
            held[free[c[o]] + rank] = v[o]
            free[sym] += count
        p += r
    own = np.repeat(start, n_l) + np.arange(int(n_l.sum())) - np.repeat(np.cumsum(n_l) - n_l, n_l)
    l_sorted = held[own]
    start = np.cumsum(n_l + n_s) - n_l - n_s
    out = np.full(n, -1, dtype=np.int64)
    out[np.repeat(start, n_l) + np.arange(len(l_sorted)) - np.repeat(np.cumsum(n_l) - n_l, n_l)] = l_sorted
    out[0] = n - 1
    free, p, width = start + n_l + n_s, n, 256
    while p > 0:
        part = out[max(0, p - width): p][::-1]
        empty = part < 0
        r = int(empty.argmax()) if empty.any() else len(part)
        width = min(1 << 16, 2 * width) if r == len(part) else max(256, 2 * r)
        v = part[:r] - 1
        v = v[v >= 0]
        v = v[s[v]]
        if len(v):
            c = t[v]
            o, rank, sym, count = _placed(c)
            out[free[c[o]] - 1 - rank] = v[o]
            free[sym] -= count
        p -= r
    return out


def plcp(raw: bytes, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, permuted common prefix with phi) by position; no prefix is longer than ``room`` of either suffix.

    Only where the symbols before a suffix and before its predecessor differ is a prefix measured; everywhere else it is one less
    than that of the position before.
    """
    n = len(sa)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    u = np.frombuffer(raw + b"\0" * 8, dtype=np.uint8)
    words = np.ndarray((n,), dtype="<u8", buffer=u.data, strides=(1,))
    i = np.arange(n)
    before = np.where(phi > 0, phi - 1, 0)
    chained = (i > 0) & (phi > 0) & (u[np.maximum(i - 1, 0)] == u[before]) & (room[np.maximum(i - 1, 0)] > 0) & (room[before] > 0)
    head = np.flatnonzero(~chained)
    value = np.zeros(n, dtype=np.int64)
    at = head[phi[head] >= 0]
    cap = np.minimum(room[at], room[phi[at]])
    k = np.zeros(len(at), dtype=np.int64)
    active = np.flatnonzero(cap > 0)
    while len(active):
        x = words[at[active] + k[active]] ^ words[phi[at[active]] + k[active]]
        low = x & (~x + np.uint64(1))
        bytes_equal = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        k[active] += bytes_equal
        active = active[(x == 0) & (k[active] < cap[active])]
    value[at] = np.minimum(k, cap)
    last = np.maximum.accumulate(np.where(chained, 0, i))
    return phi, np.maximum(value[last] - (i - last), 0)
