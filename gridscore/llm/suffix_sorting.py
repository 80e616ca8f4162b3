"""Suffix arrays by linear grouping.

First, suffixes are grouped by their Lyndon prefix: groups are taken from the largest down; every suffix of a group finds its
previous smaller suffix by following such pointers, and the suffixes pointed at move up within their own groups by how many
of the group hang on them. Then each suffix, emitted in ascending order, lets the suffixes that end before it take the next
place in their groups. No symbol is ever renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order. The last symbol must be smaller than all others."""
    n = len(text)
    symbols = np.asarray(text)
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = symbols[by_symbol]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:n])
    sizes = np.diff(np.append(starts, n))
    place, size = np.empty(n, np.int64), np.zeros(n, np.int64)
    place[by_symbol] = np.arange(n)
    group = np.empty(n, np.int64)
    group[by_symbol] = np.repeat(starts, sizes)
    size[starts] = sizes
    order, place, group, size = by_symbol.tolist(), place.tolist(), group.tolist(), size.tolist()
    smaller = [-1] * n

    end = n
    while end > 0:
        start = group[order[end - 1]]
        hanging: dict[int, int] = {}
        for i in order[start:end] if end - start == 1 else sorted(order[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                hanging[j] = hanging.get(j, 0) + 1
        if hanging:
            by_count: dict[int, list[int]] = {}
            for j, k in hanging.items():
                by_count.setdefault(k, []).append(j)
            for k in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
                rising: dict[int, list[int]] = {}
                for j in by_count[k]:
                    rising.setdefault(group[j], []).append(j)
                for old, members in rising.items():
                    if len(members) == size[old]:
                        continue
                    tail = old + size[old]
                    for j in members:
                        tail -= 1
                        other, at = order[tail], place[j]
                        order[at], place[other] = other, at
                        order[tail], place[j] = j, tail
                    for j in members:
                        group[j] = tail
                    size[tail] = len(members)
                    size[old] -= len(members)
        end = start

    free = list(range(n))
    result = [0] * n
    placed = bytearray(n + 1)  # one spare entry, for position -1
    placed[n - 1] = placed[n] = 1
    if n:
        result[0] = n - 1
    for k in range(n):
        p = result[k] - 1
        while not placed[p]:
            g = group[p]
            result[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = smaller[p]
    return result
