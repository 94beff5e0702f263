"""An R-tree over vectors of group counts, joined with itself under an overlap bound.

A set's tokens are hashed into groups; its point is the number of tokens in each group.  Two sets
share at most the sum over groups of the smaller count, and two boxes of points at most the sum of
the smaller upper corners.  Branches whose bound is below what the similarity needs are cut.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 32, 16


def needed(sizes_a, sizes_b, num: int, den: int):
    """The smallest overlap at which sets of these sizes have a Jaccard similarity of num / den."""
    total = num * (sizes_a + sizes_b)
    return -(-total // (den + num))


def search_runs(keys: np.ndarray, points: np.ndarray, sizes: np.ndarray, queries: np.ndarray, query_sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether each row may be as similar as num / den to the query of its key.

    Rows come key by key, and the rows of a key have the same query.  Each run of a key is an R-tree of
    its own, packed by size; all trees are searched together, level by level, and what a box rules out is
    not looked at again."""
    run = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
    order = np.lexsort((sizes, run))
    run = run[order]
    place = np.arange(len(run)) - np.searchsorted(run, run)
    points, sizes, queries, query_sizes = points[order], sizes[order], queries[order], query_sizes[order]
    alive = np.ones(len(run), bool)
    for span, least_rows in ((LEAF * FAN, LEAF), (LEAF, 4), (1, 0)):  # boxes of a few rows spare nothing
        starts = np.flatnonzero(place % span == 0)
        counts = np.diff(starts, append=len(run))
        tried = np.flatnonzero(alive[starts] & (counts > least_rows))
        if not len(tried):
            continue
        first, last = starts[tried], starts[tried] + counts[tried] - 1
        tops = points[first] if span == 1 else np.maximum.reduceat(points, starts, axis=0)[tried]
        bound = np.minimum(tops, queries[first]).sum(axis=1, dtype=np.int64)
        own, least, most = query_sizes[first], sizes[first], sizes[last]
        fits = (den * most >= num * own) & (den * own >= num * least) & (bound >= needed(least, own, num, den))
        lost = np.zeros(len(starts), bool)
        lost[tried[~fits]] = True
        alive &= ~np.repeat(lost, counts)
    out = np.empty(len(run), bool)
    out[order] = alive
    return out


class CountTree:
    """Points packed by sorting: slabs of like sizes, each ordered by its most spread coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * FAN
        for lo in range(0, len(order), slab):
            own = order[lo : lo + slab]
            if len(own) > LEAF:
                spread = int(np.argmax(points[own].var(axis=0)))
                order[lo : lo + slab] = own[np.argsort(points[own, spread], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        #: Per level, from the leaves up: first points, end points, upper corners, least and largest sizes.
        self.levels = []
        starts = np.arange(0, len(order), LEAF)
        ends = np.minimum(starts + LEAF, len(order))
        tops = np.maximum.reduceat(self.points, starts, axis=0)
        least, most = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        while True:
            self.levels.append((starts, ends, tops, least, most))
            if len(starts) == 1:
                break
            at = np.arange(0, len(starts), FAN)
            starts, ends = starts[at], ends[np.minimum(at + FAN, len(ends)) - 1]
            tops = np.maximum.reduceat(tops, at, axis=0)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)

    def _may(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        _, _, tops, least, most = self.levels[level]
        fits = (den * most[i] >= num * least[j]) & (den * most[j] >= num * least[i])
        bound = np.minimum(tops[i], tops[j]).sum(axis=1)
        return fits & (bound >= needed(least[i], least[j], num, den))

    def self_join(self, num: int, den: int):
        """Yield arrays (i, j) of the original rows of pairs i != j, each pair once, that may reach
        the similarity."""
        level = len(self.levels) - 1
        i = j = np.zeros(1, np.int64)
        while True:
            keep = self._may(level, i, j, num, den)
            i, j = i[keep], j[keep]
            if level == 0:
                break
            below = len(self.levels[level - 1][0])
            step = np.arange(FAN)
            a = np.repeat(i[:, None] * FAN + step, FAN, axis=1).ravel()
            b = np.tile(j[:, None] * FAN + step, FAN).ravel()
            ok = (a < below) & (b < below) & (a <= b)
            i, j = a[ok], b[ok]
            level -= 1
        starts, ends = self.levels[0][0], self.levels[0][1]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            left, right = slice(starts[x], ends[x]), slice(starts[y], ends[y])
            bound = np.minimum(self.points[left, None], self.points[None, right]).sum(axis=2)
            sizes_a, sizes_b = self.sizes[left, None], self.sizes[None, right]
            ok = (bound >= needed(sizes_a, sizes_b, num, den)) & (den * sizes_a >= num * sizes_b) & (den * sizes_b >= num * sizes_a)
            if x == y:
                ok &= np.tri(*ok.shape, -1, dtype=bool)
            p, q = np.nonzero(ok)
            if len(p):
                yield self.order[starts[x] + p], self.order[starts[y] + q]
