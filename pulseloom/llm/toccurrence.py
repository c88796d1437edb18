"""T-occurrence search over inverted lists with the DivideSkip split.

The lists of a query's shingles are divided: the longest ones are put aside, the short ones are merged with
a heap, and a document met often enough on them is looked up in the long ones by binary search until it has
the required overlap or can no longer reach it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby

import numpy as np

#: Weight of the long lists' logarithm in the choice of how many to put aside.
MU = 0.01


def least_overlap(a: int, b: int, percent: int) -> int:
    """Least i with 100*i >= percent*(a+b-i)."""
    return -(-percent * (a + b) // (100 + percent))


class Lists:
    """Inverted lists of some sets: shingle to ascending positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")
        keys, self.docs = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.start = keys[first], np.append(first, len(keys))

    def of(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(length, start) of the lists of s's shingles that exist."""
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, s)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == s)]
        return list(zip((self.start[at + 1] - self.start[at]).tolist(), self.start[at].tolist()))


def search(index: Lists, sizes: list[int], query: np.ndarray, percent: int, skip=None):
    """Yield (position, overlap) of the indexed sets whose Jaccard similarity to the query is at least percent/100.

    ``skip(position)`` true leaves a set out before it is looked up in the long lists.
    """
    n = len(query)
    lists = sorted(index.of(query))
    least = -(-percent * n // 100)
    if not n or len(lists) < least:
        return
    longest = lists[-1][0]
    aside = min(max(least - 1, 0), int(least / (MU * np.log2(max(longest, 2)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    docs = index.docs
    runs = [docs[s : s + c].tolist() for c, s in short]
    tails = [docs[s : s + c].tolist() for c, s in long] if long else []
    for doc, hits in groupby(heapq.merge(*runs)):
        m = sizes[doc]
        if 100 * min(m, n) < percent * max(m, n):
            continue
        count, need = sum(1 for _ in hits), least_overlap(n, m, percent)
        if count + len(tails) < need or skip is not None and skip(doc):
            continue
        for left, tail in zip(range(len(tails), 0, -1), tails):
            if count + left < need:
                break
            at = bisect_left(tail, doc)
            count += at < len(tail) and tail[at] == doc
        if count >= need:
            yield doc, count


def spanning_links(sets: list[np.ndarray], side: list[int], percent: int, labels: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links at the threshold connect (a spanning forest).

    side: 0 or 1 for each set. If both occur, only pairs across the sides are asked for, else all pairs.
    labels: sets of one label are known to be connected. A pair already connected is not looked up again.
    """
    up = list(range(len(sets)))
    if labels is not None:
        first: dict = {}
        up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    held = [i for i in range(len(sets)) if side[i] == 1] if len(set(side)) == 2 else list(range(len(sets)))
    asks = [i for i in range(len(sets)) if side[i] == 0] if len(set(side)) == 2 else held
    index, sizes, found = Lists([sets[i] for i in held]), [len(sets[i]) for i in held], []
    for i in asks:

        def joined(p: int) -> bool:
            return root(held[p]) == root(i)

        for p, _ in search(index, sizes, sets[i], percent, joined):
            j = held[p]
            if (other := root(j)) != (mine := root(i)):
                up[max(mine, other)] = min(mine, other)
                found.append((i, j))
    return found


def roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    """For each of n sets the least position that the links connect it with."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
