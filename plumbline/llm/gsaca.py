"""Suffix arrays by linear grouping construction, for many strings side by side.

Phase 1 groups the suffixes of a string by their Lyndon prefixes. The groups are kept in
order as intervals of the array to be built. They are handled from the last to the first:
for each suffix of the group its previous smaller suffix is found by following pointers;
that suffix's prefix now also covers the suffix of the group, so it moves up, out of its
own group into a new one behind it, the further the more suffixes of the handled group it
took up. Phase 2 goes over the array once: a suffix in place puts the suffix before it, and
along the previous-smaller pointers those whose next smaller suffix it is, at the front of
their groups. Nothing is renamed and nothing recurs.

A step handles the next group, or entry, of every string of a batch at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _group(text: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: each suffix's group, named by its first place in the array, and previous smaller suffix (or -1)."""
    n = len(text)
    string = np.repeat(np.arange(len(base)), size)
    key = string * (int(text.max(initial=0)) + 1) + text
    at = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(key[at]) != 0)) if n else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, n))
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    group = np.empty(n, np.int64)
    group[at] = np.repeat(heads, counts)
    length = np.zeros(n, np.int64)
    length[heads] = counts
    head_of = np.zeros(n, np.int64)  # by a group's last place
    head_of[heads + counts - 1] = heads
    smaller = np.arange(-1, n - 1)
    smaller[base] = -1
    moved = np.zeros(n, bool)
    end = base + size - 1
    while True:
        live = end > base  # the group of the end mark is left
        if not live.all():
            end, base = end[live], base[live]
        if not len(end):
            return group, smaller
        begin = head_of[end]
        members = at[_ranges(begin, end - begin + 1)]
        end = begin - 1
        pending, own = members, group[members]
        while True:
            p = smaller[pending]
            again = (p >= 0) & (group[p] >= own)
            if not again.any():
                break
            pending, own = pending[again], own[again]
            smaller[pending] = smaller[p[again]]
        up = smaller[members]
        up, taken = np.unique(up[up >= 0], return_counts=True)
        if not len(up):
            continue
        order = np.lexsort((taken, group[up]))
        up, taken = up[order], taken[order]
        g = group[up]
        new = np.append(True, g[1:] != g[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(g)))
        old = g[first]
        tail = old + length[old] - many
        to = _ranges(tail, many)
        there, was = at[to], place[up]
        moved[up] = True
        stay, free = there[~moved[there]], was[was < np.repeat(tail, many)]
        moved[up] = False
        at[free], place[stay] = stay, free
        at[to], place[up] = up, to
        length[old] -= many
        rest = length[old] > 0
        head_of[tail[rest] - 1] = old[rest]
        cut = np.flatnonzero(new | np.append(True, taken[1:] != taken[:-1]))
        heads, counts = to[cut], np.diff(np.append(cut, len(to)))
        length[heads] = counts
        head_of[heads + counts - 1] = heads
        group[up] = np.repeat(heads, counts)


def _order(group: np.ndarray, smaller: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Phase 2 for many strings at once."""
    n = len(group)
    out, front, placed = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    last = base + size - 1
    out[base] = last
    placed[last] = True
    longest_first = np.argsort(-size, kind="stable")
    base, size = base[longest_first], size[longest_first]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for i, k in enumerate(live):
        s = out[base[:k] + i] - 1
        s = s[s >= base[:k]]
        while True:
            s = s[~placed[s]]
            if not len(s):
                break
            g = group[s]
            to = front[g]
            out[to] = s
            front[g] = to + 1
            placed[s] = True
            s = smaller[s]
            s = s[s >= 0]
    return out


def _order_one(group: list[int], smaller: list[int]) -> list[int]:
    """Phase 2 for one string."""
    n = len(group)
    out, front, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            to = front[g]
            out[to] = s
            front[g] = to + 1
            placed[s] = 1
            s = smaller[s]
    return out


def suffix_arrays(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """text: strings one after another, each ending in its only 0; size: their lengths.

    Returns their suffix arrays one after another, as places in text.
    """
    base = np.cumsum(size) - size
    group, smaller = _group(text.astype(np.int64), base, size)
    if len(size) >= 24:
        return _order(group, smaller, base, size)
    out = np.empty(len(text), np.int64)
    for b, n in zip(base.tolist(), size.tolist(), strict=True):
        out[b : b + n] = np.array(_order_one((group[b : b + n] - b).tolist(), np.maximum(smaller[b : b + n] - b, -1).tolist())) + b
    return out
