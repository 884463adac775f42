"""Suffix arrays by linear grouping.

Suffixes start in groups by their first symbol.  Groups are taken in descending order; when a group's turn
comes, all its suffixes begin with the same Lyndon word, and each is looked back from to the nearest earlier
suffix of a smaller group (its previous-smaller pointer).  A suffix that k members of the group point to has
its own prefix followed by k copies of that word, so it leaves its group for a new one right behind it,
further behind the larger k is.  When all groups are done, a suffix's group stands for its Lyndon prefix.

The second pass emits the order group by group in ascending order: once a suffix is placed, the suffixes found
by following previous-smaller pointers from its left neighbour are each next in their group.  No symbols are
renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The start of each suffix in ascending order; a proper prefix sorts first.  `symbols`: non-negative integers."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    members = np.argsort(symbols, kind="stable")
    keys = symbols[members]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    group_of = np.repeat(first, np.diff(np.append(first, n)))
    place = np.empty(n, np.int64)
    place[members] = np.arange(n)
    group = np.empty(n, np.int64)
    group[members] = group_of
    order, place, group = members.tolist(), place.tolist(), group.tolist()
    # `group` holds for each suffix where its group starts in `order`; `ends` where that group ends.
    ends = {int(a): int(b) for a, b in zip(first, np.append(first[1:], n), strict=True)}
    previous = [-1] * n
    look_back(order, place, group, ends, previous)
    return np.array(emit(order, group, previous), dtype=np.int64)


def look_back(order: list[int], place: list[int], group: list[int], ends: dict[int, int], previous: list[int]) -> None:
    """First pass: `group` ends up ordered by Lyndon prefix, `previous` points to the previous smaller suffix."""
    end = len(order)
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] > start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                move([p], order, place, group, ends)
            end = start
            continue
        pointed: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        by_count: dict[int, list[int]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            move(by_count[k], order, place, group, ends)


def move(some: list[int], order: list[int], place: list[int], group: list[int], ends: dict[int, int]) -> None:
    """Those of `some` that share a group leave it for a new group right behind it."""
    touched: dict[int, int] = {}
    for p in some:
        start = group[p]
        last = touched[start] if start in touched else ends[start]
        touched[start] = last = last - 1
        at, other = place[p], order[last]
        order[at], order[last] = other, p
        place[other], place[p] = at, last
    for start, new in touched.items():
        end = ends[start]
        if new == start:
            continue  # the whole group moved: it keeps its place
        ends[start], ends[new] = new, end
        for k in range(new, end):
            group[order[k]] = new


def emit(order: list[int], group: list[int], previous: list[int]) -> list[int]:
    """Second pass: the sorted suffixes."""
    n = len(order)
    result = [-1] * n
    ahead = list(range(n))  # for the start of a group: where its next suffix goes
    placed = bytearray(n)
    at = n - 1
    for rank in range(-1, n):
        # The empty suffix behind the text is the smallest of all and comes before the others.
        p = at if rank < 0 else result[rank] - 1
        while p >= 0 and not placed[p]:
            start = group[p]
            result[ahead[start]] = p
            ahead[start] += 1
            placed[p] = 1
            p = previous[p]
    return result
