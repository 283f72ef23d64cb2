"""Suffix arrays by linear grouping construction, many short texts side by side.

Phase one processes groups of suffixes in descending order. For every suffix of the current group the pointer to
the previous smaller suffix is found by following earlier pointers; the suffixes pointed to leave the top of their
own groups, ordered by how many pointers they got. In the end a group holds the suffixes with one Lyndon prefix.
Phase two goes through the order as it arises: the suffix before the current one, and those on its chain of
previous smaller suffixes that have no place yet, take the next places of their groups. No names are assigned anew
and nothing is sorted recursively.

Each text is a lane. All lanes advance together, one group (or one place) each per step, so that numpy works on
arrays as wide as there are lanes; the work stays linear in the total length.
"""

from __future__ import annotations

import numpy as np


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then start[1], ..."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size - start, size)


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The suffix arrays of all lanes end to end, as places in `symbols`.

    Lane k is symbols[begin[k] : begin[k + 1]] and ends with a 0, which it has nowhere else.
    """
    if not len(symbols):
        return np.zeros(0, np.int32)
    group, before, low, high, _ = _grouped(symbols, begin)
    return _emit(group, before, low, high)


def lyndon_arrays(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one alone: of every place the length of the longest Lyndon word that begins there, and a number that
    places of a lane share exactly if that word is the same. Lanes are as in `suffix_arrays`.
    """
    if not len(symbols):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    group, _, _, _, length = _grouped(symbols, begin)
    return length[group[:-1]], group[:-1]


def _grouped(symbols: np.ndarray, begin: np.ndarray):
    """Phase one: each place's group (its first place in the order), previous smaller suffix, the lanes' bounds, and each
    group's Lyndon word's length at the group's first place."""
    n, lanes = len(symbols), len(begin) - 1
    low, high = begin[:-1].astype(np.int32), begin[1:].astype(np.int32)
    lane = np.repeat(np.arange(lanes), np.diff(begin))
    order = np.argsort(lane * (int(symbols.max()) + 1) + symbols, kind="stable").astype(np.int32)
    by = symbols[order]
    head = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]) | (lane[order][1:] != lane[order][:-1])])).astype(np.int32)
    size = np.zeros(n, np.int32)
    size[head] = np.diff(np.append(head, n))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    group = np.full(n + 1, -1, np.int32)  # the first place of a suffix's group; none for n, which stands for "nothing"
    group[order] = np.repeat(head, size[head])
    before = np.arange(-1, n, dtype=np.int32)
    before[low] = n
    length = np.ones(n, np.int32)
    _group(order, place, group, size, before, low, high, length)
    return group, before, low, high, length


def _group(order, place, group, size, before, low, high, length) -> None:
    n = len(order)
    current = np.zeros(len(low), np.int32)  # the length of each lane's current Lyndon word
    moving = np.zeros(n, bool)
    top = high.copy()
    live = np.arange(len(low))
    while len(live):
        end = top[live]
        start = group[order[end - 1]]
        top[live] = start
        current[live] = length[start]
        members = order[_ragged(start, end - start)]
        own = np.repeat(start, end - start)
        point = before[members]
        while True:  # pointers of the group itself shorten as they are followed
            far = np.flatnonzero(group[point] >= own)
            if not len(far):
                break
            point[far] = before[point[far]]
            before[members[far]] = point[far]
        live = live[start > low[live]]
        point = np.sort(point[point < n])
        if not len(point):
            continue
        at = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
        times = np.diff(np.append(at, len(point)))
        up = point[at]
        of = group[up]
        by = np.argsort(of.astype(np.int64) * (int(times.max()) + 1) + times, kind="stable")
        up, times, of = up[by], times[by], of[by]
        first = np.concatenate([[True], of[1:] != of[:-1]])
        at = np.flatnonzero(first)
        leaving = np.diff(np.append(at, len(up)))
        edge = of[at] + size[of[at]] - leaving  # where those that leave begin
        to = _ragged(edge, leaving)
        moving[up] = True
        there = order[to]
        stay = there[~moving[there]]
        was = place[up]
        gap = was[was < np.repeat(edge, leaving)]
        order[gap], place[stay] = stay, gap
        order[to], place[up] = up, to
        moving[up] = False
        size[of[at]] -= leaving.astype(np.int32)
        new = np.flatnonzero(first | np.concatenate([[True], times[1:] != times[:-1]]))
        count = np.diff(np.append(new, len(up)))
        size[to[new]] = count
        length[to[new]] = length[of[new]] + times[new].astype(np.int32) * current[np.searchsorted(low, up[new], side="right") - 1]
        group[up] = np.repeat(to[new], count)


def _emit(group, before, low, high) -> np.ndarray:
    n = len(group) - 1
    out = np.full(n, -1, np.int32)
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    free = np.arange(n + 1, dtype=np.int32)  # the next place of the group that begins there
    i, end = low.copy(), high
    out[i] = end - 1
    placed[end - 1] = True
    left = np.arange(-1, n, dtype=np.int32)
    left[low] = n
    at = left[end - 1]
    while len(i):
        done = placed[at]
        i = i + done
        over = i == end
        if over.any():
            keep = ~over
            i, end, at, done = i[keep], end[keep], at[keep], done[keep]
        at = np.where(done, left[out[i]], at)
        go = np.flatnonzero(~placed[at])
        j = at[go]
        g = group[j]
        s = free[g]
        out[s] = j
        free[g] = s + 1
        placed[j] = True
        at[go] = before[j]
    return out
