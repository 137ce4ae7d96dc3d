"""Suffix arrays by linear grouping.

Phase one groups suffixes by their longest Lyndon prefix. Groups are taken in descending order; each suffix of a group
points to the last suffix before it in a lower group, and the suffixes pointed to move up inside their own groups, the
further the more pointers they get: their prefix grows by the group's own, once for each pointer. Phase two walks the
array from its least suffix on: the suffix before it, and those that its pointers lead to, are the next of their groups.
No string is renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` (integers) in order; an end is less than every integer."""
    n = len(text) + 1
    s = np.empty(n, np.int64)
    s[:-1] = text
    s[-1] = (int(text.min()) if n > 1 else 0) - 1  # the end
    order = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    firsts = np.flatnonzero(new)
    sizes = np.zeros(n, np.int64)
    sizes[firsts] = np.diff(np.append(firsts, n))
    group = np.empty(n, np.int64)
    group[order] = firsts[np.cumsum(new) - 1]
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    # plain lists are faster for single steps
    order, at, group, size = order.tolist(), at.tolist(), group.tolist(), sizes.tolist()
    before = [-1] * n
    end = n - 1
    while end > 0:
        first = group[order[end]]
        if first == end:
            i = order[end]
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                left = size[g] - 1
                if left:
                    size[g] = left
                    to = g + left
                    x, y = order[to], at[p]
                    order[y], at[x] = x, y
                    order[to], at[p] = p, to
                    group[p] = to
                    size[to] = 1
            end -= 1
            continue
        pointers: dict[int, int] = {}
        for i in sorted(order[first : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in pointers.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[k]:
                g = group[p]
                size[g] -= 1
                to = g + size[g]
                x, y = order[to], at[p]
                order[y], at[x] = x, y
                order[to], at[p] = p, to
                moved[g] = moved.get(g, 0) + 1
            for g, n_moved in moved.items():
                start = g + size[g]
                size[start] = n_moved  # g itself, if all of it moved
            for p in by_count[k]:
                group[p] += size[group[p]] if at[p] >= group[p] + size[group[p]] else 0
        end = first - 1
    out, done = [0] * n, bytearray(n)
    place = list(range(n))
    out[0] = n - 1
    done[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            done[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)
