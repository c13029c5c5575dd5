"""Suffix arrays of many short texts at once, by the grouping construction.

Suffixes are kept in groups, ordered among themselves; at first a group is the
suffixes of one symbol.  The groups of a text are processed in descending
order.  For every suffix of the current group the previous-smaller pointer is
followed to the nearest earlier suffix of a lower group; the suffixes so
reached leave their group for new ones right above it, the more pointers reach
them the higher, because their known prefix grows by that many copies of the
current group's prefix.  When all groups have been processed each holds the
suffixes of one Lyndon prefix.  A suffix is its Lyndon prefix followed by the
next smaller suffix, so ascending through the groups, each group's order
follows from the ranks of those suffixes, which lower groups (or the same
group, counted as repetitions) already hold.  Nothing is renamed or recursed.

The texts of a batch go through these steps side by side: one step takes the
current group of every text, with NumPy over all of them.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``start``, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Groups:
    """Groups of the suffixes of a batch; a group is named by its first slot."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        n = len(symbols)
        self.high = np.cumsum(sizes)
        self.low = self.high - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.lexsort((symbols, text))  # slot -> suffix
        self.slot = np.empty(n, np.int64)  # suffix -> slot
        self.slot[self.order] = np.arange(n)
        s, x = symbols[self.order], text[self.order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])) if n else np.zeros(0, int)
        count = np.diff(np.concatenate([first, [n]]))
        self.group = np.empty(n, np.int64)  # suffix -> its group
        self.group[self.order] = np.repeat(first, count)
        self.size = np.zeros(n, np.int64)
        self.size[first] = count
        self.before = np.arange(n) - 1  # previous-smaller pointers
        self.lyndon = np.ones(n, np.int64)  # length of the known prefix
        self.marked = np.zeros(n, bool)

    def follow(self, suffix: np.ndarray, group: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Nearest earlier suffixes of lower groups (less than ``low``: none)."""
        at, before = self.before[suffix], self.before
        todo = np.flatnonzero((at >= low) & (self.group[at] >= group))
        while len(todo):
            at[todo] = before[at[todo]]
            before[suffix[todo]] = at[todo]
            todo = todo[(at[todo] >= low[todo]) & (self.group[at[todo]] >= group[todo])]
        before[suffix] = at
        return at

    def lift(self, suffix: np.ndarray, times: np.ndarray) -> None:
        """Moves suffixes to new groups right above their own, by ``times``."""
        old = self.group[suffix]
        by = np.lexsort((times, old))
        suffix, times, old = suffix[by], times[by], old[by]
        other = np.concatenate([[True], old[1:] != old[:-1]])
        head = np.flatnonzero(other)
        count = np.diff(np.concatenate([head, [len(old)]]))
        left = old[head] + self.size[old[head]] - count  # first slot that the lifted ones take
        slots = np.repeat(left - head, count) + np.arange(len(old))
        was = self.slot[suffix]
        vacated = was[was < np.repeat(left, count)]
        self.marked[suffix] = True
        there = self.order[slots]
        moved = there[~self.marked[there]]
        self.marked[suffix] = False
        self.order[vacated], self.slot[moved] = moved, vacated
        self.order[slots], self.slot[suffix] = suffix, slots
        other[1:] |= times[1:] != times[:-1]
        made = np.flatnonzero(other)
        sizes = np.diff(np.concatenate([made, [len(old)]]))
        self.size[old[head]] -= count
        self.size[slots[made]] = sizes
        self.group[suffix] = np.repeat(slots[made], sizes)

    def refine(self) -> None:
        """Processes the groups of every text in descending order."""
        last, low = self.high - 1, self.low
        while len(last):
            group = self.group[self.order[last]]
            size = last - group + 1
            suffix = self.order[_ranges(group, size)]
            at = self.follow(suffix, np.repeat(group, size), floor := np.repeat(low, size))
            hit = at >= floor
            if hit.any():
                reached, one, times = np.unique(at[hit], return_index=True, return_counts=True)
                self.lyndon[reached] += times * self.lyndon[suffix[hit][one]]
                self.lift(reached, times)
            last = group - 1
            more = last >= low
            last, low = last[more], low[more]

    def emit(self) -> np.ndarray:
        """Orders every group, ascending; returns the suffixes by rank."""
        rank, n = self.slot.copy(), len(self.slot)
        many = np.flatnonzero(self.size[self.group[self.order]] > 1)  # slots of groups still to order
        if not len(many):
            return self.order
        first = np.unique(self.group[self.order[many]])
        text = np.searchsorted(self.high, first, "right")
        begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        count = np.diff(np.concatenate([begin, [len(first)]]))
        for step in range(int(count.max())):
            group = first[begin[count > step] + step]
            size = self.size[group]
            suffix = self.order[_ranges(group, size)]
            own = np.repeat(group, size)
            times, after = np.zeros(len(suffix), np.int64), suffix + self.lyndon[suffix]
            same = np.flatnonzero(self.group[np.minimum(after, n - 1)] == own)
            while len(same):
                times[same] += 1
                after[same] += self.lyndon[after[same]]
                same = same[self.group[np.minimum(after[same], n - 1)] == own[same]]
            by = np.lexsort((rank[np.minimum(after, n - 1)], times, own))
            slots = _ranges(group, size)
            self.order[slots] = suffix[by]
            rank[suffix[by]] = slots
        return self.order


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts that stand one after the other, as positions
    in ``symbols``.  Every text ends with a symbol below all its others."""
    groups = Groups(symbols, sizes)
    groups.refine()
    return groups.emit()
