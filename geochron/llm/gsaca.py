"""Suffix sorting by grouping (Baier 2016), for many strings at once.

Phase 1 puts every suffix into the group of its Lyndon prefix.  Groups are taken from the largest down.
Each member follows the previous-smaller pointers to the nearest earlier suffix of a smaller group; those suffixes
continue with the members' Lyndon prefix, so they leave their group for one of their own right after it (one for each number of
repeats).  Phase 2 walks the suffix array from its smallest entry and puts the suffixes whose Lyndon prefix ends
there at the front of their groups.  No suffixes are renamed and no smaller problem is solved in between.

Both phases advance all strings in step, a group (or an entry) of each at a time, so the numpy calls
are shared by the whole batch; the work is linear in the batch's bytes but for sorting within a step.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The suffix arrays of strings that lie back to back and begin at ``start``, back to back too, as positions in text.

    text: non-negative integers.  The end of a string is smaller than any symbol.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    size_of = np.diff(np.append(start, n))
    start, size_of = start[size_of > 0], size_of[size_of > 0]
    string = np.repeat(np.arange(len(start)), size_of)
    # First groups: suffixes by string and first symbol.  A group is known by the place in the suffix array where it begins.
    order = np.lexsort((text, string))
    new = np.append(True, (text[order][1:] != text[order][:-1]) | (string[order][1:] != string[order][:-1]))
    first = np.flatnonzero(new)
    group = np.empty(n, np.int64)
    group[order] = first[np.cumsum(new) - 1]
    count = np.zeros(n + 1, np.int64)  # members of the group that begins here
    count[first] = np.diff(np.append(first, n))
    before = np.arange(n) - 1
    before[start] = -1
    # Members of a group stand together in ``order``; groups split in place.
    top = start + size_of  # one past the last place not yet done, in each string
    end_of = np.zeros(n + 1, np.int64)  # place after a group -> where the group begins
    end_of[first + count[first]] = first
    position = np.empty(n, np.int64)
    position[order] = np.arange(n)
    moving = np.zeros(n, bool)
    live = np.arange(len(start))
    while len(live):
        lo = end_of[top[live]]
        sizes = count[lo]
        member = order[np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        mine = np.repeat(lo, sizes)
        # Previous-smaller pointers: pass over suffixes of larger groups, and over fellow members, whose own pointers are being found.
        cur = before[member]
        active = np.flatnonzero((cur >= 0) & (group[cur] >= mine))
        while len(active):
            c = before[cur[active]]
            cur[active] = c
            before[member[active]] = c
            active = active[(c >= 0) & (group[c] >= mine[active])]
        # How often each earlier suffix was pointed at; it moves by that many repeats.
        told = cur[cur >= 0]
        if len(told):
            p, k = np.unique(told, return_counts=True)
            g = group[p]
            move = np.lexsort((p, k, g))
            p, k, g = p[move], k[move], g[move]
            head = np.append(True, g[1:] != g[:-1])
            at = np.flatnonzero(head)
            moved = np.diff(np.append(at, len(p)))
            old, total = g[at], count[g[at]]
            # The movers take the last places of their group; those who stand there and stay take the movers' places.
            edge = np.repeat(old + total - moved, moved)
            place = edge + np.arange(len(p)) - np.repeat(at, moved)
            moving[p] = True
            standing = order[place]
            stay = standing[~moving[standing]]
            free = position[p][position[p] < edge]
            moving[p] = False
            order[free], position[stay] = stay, free
            order[place], position[p] = p, place
            start_new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
            s = np.flatnonzero(start_new)
            fresh = place[s]
            group[p] = fresh[np.cumsum(start_new) - 1]
            count[fresh] = np.diff(np.append(s, len(p)))
            end_of[fresh + count[fresh]] = fresh
            left = total - moved
            keep = left > 0
            count[old[keep]] = left[keep]
            end_of[(old + left)[keep]] = old[keep]
        top[live] = lo
        live = live[top[live] > start[live]]

    # Phase 2.  The empty suffix comes first; then every entry places the suffixes whose Lyndon prefix ends where it begins.
    out = np.full(n, -1, np.int64)
    front = np.arange(n)
    open_ = np.ones(n + 1, bool)  # not yet placed; the last entry is for -1, no suffix
    open_[n] = False

    def place_before(s: np.ndarray, low: np.ndarray) -> None:
        j = s - 1
        j = j[j >= low]
        j = j[open_[j]]
        while len(j):
            g = group[j]
            f = front[g]
            out[f] = j
            front[g] = f + 1
            open_[j] = False
            j = before[j]
            j = j[open_[j]]

    place_before(start + size_of, start)
    live, at = np.arange(len(start)), 0
    while len(live):
        place_before(out[start[live] + at], start[live])
        at += 1
        live = live[size_of[live] > at]
    return out
