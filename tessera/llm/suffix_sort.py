"""Suffix arrays by linear grouping.

Suffixes are first grouped by their longest Lyndon prefix. Groups are taken in descending order;
every suffix of a group points to the nearest suffix before it in a lower group, and that one's
prefix grows by the group's, which moves it up within its own group. Then the groups' order is
emitted from the lowest suffix on, each placed suffix pulling those that point to it. No
reduced text is ever renamed and sorted again.
"""

from __future__ import annotations


def suffix_order(text: list[int]) -> list[int]:
    """The start positions of all suffixes of ``text`` in ascending order."""
    if not text:
        return []
    return _emit(*_grouped([*text, min(text) - 1]))[1:]


def _grouped(text: list[int]) -> tuple[list[int], list[int]]:
    """For every suffix the start of its final group, and the nearest suffix before it in a lower group.

    The last symbol must be smaller than all others.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for at, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = at
        place[s] = at
        group[s] = start
        size[start] += 1

    end = n - 1
    while end >= 0:
        first = group[order[end]]
        if first == end:
            s = order[end]
            p = s - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            before[s] = p
            if p >= 0:
                _raise_up([p], order, place, group, size)
            end = first - 1
            continue
        followers: dict[int, int] = {}
        for s in sorted(order[first : end + 1]):
            p = s - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            if p >= 0 and group[p] == first:
                p = before[p]
            before[s] = p
            if p >= 0:
                followers[p] = followers.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, count in followers.items():
            by_count.setdefault(count, []).append(p)
        for count in sorted(by_count, reverse=True):
            _raise_up(by_count[count], order, place, group, size)
        end = first - 1
    return group, before


def _raise_up(some: list[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Those of ``some`` that share a group leave it for a new one just above it."""
    moved: dict[int, int] = {}
    for s in some:
        g = group[s]
        m = moved.get(g, 0)
        to, at = g + size[g] - 1 - m, place[s]
        if to != at:
            other = order[to]
            order[at], place[other] = other, at
            order[to], place[s] = s, to
        moved[g] = m + 1
    for s in some:
        g = group[s]
        group[s] = g + size[g] - moved[g]
    for g, m in moved.items():
        if m < size[g]:
            size[g] -= m
            size[g + size[g]] = m


def _emit(group: list[int], before: list[int]) -> list[int]:
    n = len(group)
    out, front, placed = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    front[group[n - 1]] += 1
    for rank in range(n):
        s = out[rank] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = before[s]
    return out
