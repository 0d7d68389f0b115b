"""Suffix arrays by linear grouping, for many small strings in step.

Phase 1 sorts suffixes into groups of equal Lyndon prefix. Groups are processed in descending order; each member
points to its previous smaller suffix, the last one before it in a lower group, found by following the pointers of
members that were processed before. Suffixes that so many members of a group point to move together into a new group
right after their old one, those with more pointers further up. Phase 2 emits the order within each group in one
ascending sweep: when a suffix gets its place, the suffixes that end their Lyndon prefix there, which are reached by
the same pointers, take the next free places of their groups. Nothing is renamed and nothing recurses.

Every string is independent of the others, so all strings advance together: step t processes the t-th highest group,
or the t-th sweep move, of all strings at once.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings laid end to end: entry i holds a position, each string's in its own range.

    ``starts`` has the start of each string and the total length at its end. Every string must end with a symbol that
    is smaller than all its others.
    """
    n = len(symbols)
    sa, group, size = _grouped(symbols, starts)
    before = np.arange(-1, n - 1)
    before[starts[:-1]] = -1
    place = np.empty(n, dtype=np.int64)
    place[sa] = np.arange(n)
    moved = np.zeros(n, dtype=bool)
    top = starts[1:].copy()
    live = np.flatnonzero(top > starts[:-1])
    while len(live):
        high = top[live]
        low = group[sa[high - 1]]
        back = _point_back(sa[_ranges(low, high)], group, before)
        if len(back):
            _move_up(back, sa, place, group, size, moved)
        top[live] = low
        live = live[low > starts[live]]
    del sa, place, size, moved
    return _emit(starts, group, before, n)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one range after the other."""
    length = high - low
    return np.repeat(high - np.cumsum(length), length) + np.arange(int(length.sum()))


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    """Lengths of runs that start at ``first``, the last of which ends at n."""
    out = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=out[:-1])
    out[-1:] = n - first[-1:]
    return out


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _grouped(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first groups: by string and symbol. Positions in group order, each position's group start, group sizes.

    The group starts have one more entry, lower than all, for a pointer of -1.
    """
    n = len(symbols)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = owner * 512 + symbols
    sa = np.argsort(key, kind="stable")
    first = np.flatnonzero(_heads(key[sa]))
    lengths = _lengths(first, n)
    group = np.full(n + 1, -1, dtype=np.int64)
    group[sa] = np.repeat(first, lengths)
    size = np.zeros(n, dtype=np.int64)
    size[first] = lengths
    return sa, group, size


def _point_back(members: np.ndarray, group: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Follow the pointers of the members until each meets a lower group, or the start of its string; where they lead."""
    todo, own, p = members, group[members], before[members]
    while len(skip := np.flatnonzero(group[p] >= own)):
        todo, own, p = todo[skip], own[skip], before[p[skip]]
        before[todo] = p
    back = before[members]
    return back[back >= 0]


def _move_up(back: np.ndarray, sa: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, moved: np.ndarray) -> None:
    """Move the suffixes that are pointed to into new groups at the upper end of their old ones, by number of pointers."""
    back.sort()
    first = np.flatnonzero(_heads(back))
    which, pointers = back[first], _lengths(first, len(back))
    old = group[which]
    order = np.argsort((old << 32) | pointers, kind="stable")
    which, pointers, old = which[order], pointers[order], old[order]
    new_old = _heads(old)
    first = np.flatnonzero(new_old)
    count = _lengths(first, len(which))
    low = old[first]
    tail = low + size[low] - count  # where the moved part of each old group starts
    target = np.repeat(tail - first, count) + np.arange(len(which))
    moved[which] = True
    there = sa[target]
    out = there[~moved[there]]
    if len(out):
        holes = place[which]
        holes = holes[holes < np.repeat(tail, count)]
        sa[holes] = out
        place[out] = holes
    sa[target] = which
    place[which] = target
    moved[which] = False
    size[low] -= count
    run = np.flatnonzero(new_old | _heads(pointers))
    length = _lengths(run, len(which))
    group[which] = np.repeat(target[run], length)
    size[target[run]] = length


def _emit(starts: np.ndarray, group: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """Final order: each string's last position comes first, and every place found lets others follow.

    A move of a string either places a suffix or goes to the next place, so a string of m suffixes takes 2m - 2 moves.
    Strings go by length, so that those with moves left are always the first ones.
    """
    length = np.diff(starts)
    by = np.argsort(-length, kind="stable")
    by = by[length[by] > 0]
    begin, last = starts[:-1][by], starts[1:][by] - 1
    moves = 2 * length[by] - 2
    left = np.searchsorted(-moves, -np.arange(moves[0] if len(by) else 0), side="left")
    out = np.empty(n, dtype=np.int64)
    free = np.arange(n)  # the next free place of each group, at the group's start
    placed = np.zeros(n + 1, dtype=bool)
    placed[-1] = True  # where a pointer of -1 leads
    preceding = np.arange(-1, n - 1)
    preceding[begin] = -1
    out[begin] = last
    placed[last] = True
    free[group[last]] += 1
    rank, at = begin.copy(), preceding[last]
    for k in left.tolist():
        s = at[:k]
        stuck = placed[s]
        stay = stuck.nonzero()[0]
        go = (~stuck).nonzero()[0]
        x = s[go]
        g = group[x]
        f = free[g]
        out[f] = x
        free[g] = f + 1
        placed[x] = True
        s[go] = before[x]
        r = rank[stay] + 1
        rank[stay] = r
        s[stay] = preceding[out[r]]
    return out
