"""Suffix array by linear grouping: suffixes are grouped by their Lyndon prefixes, groups are processed in descending
order with previous-smaller pointers, and a second pass emits the order inside the groups. Nothing is renamed or recursed.

Members of a group are put in order by Python's sort, where the linear construction keeps them so in arrays: a logarithm
of the group's size is added, in exchange for short code.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start positions of the suffixes in ascending order. The end of the sequence counts as less than any symbol."""
    n = len(symbols) + 1  # with the empty suffix
    members: dict[int, list[int]] = {}  # by a group's first place among all suffixes
    group = [0] * n
    size = [0] * n
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    at = 1
    members[0], size[0] = [n - 1], 1
    for s in sorted(by_symbol):
        own = by_symbol[s]
        members[at], size[at] = own, len(own)
        for i in own:
            group[i] = at
        at += len(own)

    # Phase 1: refine lower groups by what follows them, from the highest group down.
    smaller = [-1] * n
    for g in range(n - 1, 0, -1):
        if not size[g]:
            continue
        times: Counter[int] = Counter()
        for i in sorted(i for i in members[g] if group[i] == g):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] += 1
        if not times:
            continue
        # Those that are followed by the group's prefix more often stand higher.
        split: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, often in times.items():
            split[(-often, group[j])].append(j)
        for _, old in sorted(split):
            moved = split[(_, old)]
            if len(moved) == size[old]:
                continue
            new = old + size[old] - len(moved)
            size[old] -= len(moved)
            size[new] = len(moved)
            members[new] = moved
            for j in moved:
                group[j] = new

    # Phase 2: each placed suffix puts those before it, along the pointers, at the front of their groups.
    front, placed, order = list(range(n)), [False] * n, [-1] * n
    order[0], placed[n - 1] = n - 1, True
    for place in range(n):
        j = order[place] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = smaller[j]
    return order[1:]
