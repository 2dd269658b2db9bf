"""Suffix arrays by linear grouping.

A suffix belongs to a group with all suffixes that start with the same Lyndon word. Groups are formed from
first symbols and refined in descending order: each finished group extends the words of the suffixes that
its members point to, the previous smaller ones. The order inside the groups then follows from one pass
over the array, in which each suffix names those whose word ends right before it. Nothing is renamed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def grouped(text: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Suffixes in the order of their groups, the start of each one's group, and each one's pointer to the
    previous suffix of a smaller group (-1: none).

    ``text`` holds non-negative integers and ends with a symbol smaller than all others.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    sa = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    isa = place.tolist()
    sizes = np.bincount(text)
    starts = np.cumsum(sizes) - sizes
    group = starts[text].tolist()
    ends = [0] * n  # by a group's start
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size:
            ends[start] = start + size
    prev = [-1] * n

    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            s = sa[start]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                g = group[p]
                last = ends[g] - 1
                if last > g:
                    i = isa[p]
                    q = sa[last]
                    sa[i], isa[q] = q, i
                    sa[last], isa[p] = p, last
                    ends[g] = last
                    ends[last] = last + 1
                    group[p] = last
            end = start
            continue
        found = []
        for s in sorted(sa[start:end]):
            p = s - 1
            while p >= 0 and group[p] > start:
                p = prev[p]
            if p >= 0 and group[p] == start:  # a repeat of the group's own word
                p = prev[p]
            prev[s] = p
            if p >= 0:
                found.append(p)
        end = start
        # suffixes with more repeats of this group's word behind theirs are larger
        levels: dict[int, list[int]] = {}
        if len(set(found)) == len(found):
            levels[1] = found
        else:
            for p, repeats in Counter(found).items():
                levels.setdefault(repeats, []).append(p)
        for repeats in sorted(levels, reverse=True):
            before: dict[int, int] = {}
            for p in levels[repeats]:
                g = group[p]
                last = ends[g]
                if g not in before:
                    before[g] = last
                last -= 1
                i = isa[p]
                q = sa[last]
                sa[i], isa[q] = q, i
                sa[last], isa[p] = p, last
                ends[g] = last
            for p in levels[repeats]:
                group[p] = ends[group[p]]
            for g, old in before.items():
                ends[ends[g]] = old
    return sa, group, prev


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; ``text`` as in ``grouped``."""
    n = len(text)
    _, group, prev = grouped(text)
    front = list(range(n))  # the next free place, by a group's start
    out = [0] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            at = front[g]
            out[at] = s
            front[g] = at + 1
            done[s] = 1
            s = prev[s]
    return np.array(out, np.int64)
