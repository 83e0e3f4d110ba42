"""Count vectors of sets in a packed R-tree, joined with itself under a bound on overlaps.

The items of a set are dealt into groups by hash; a set becomes the point of
its counts by group. Two sets share no more items of a group than the smaller
of their counts there, so the sum of the coordinates' minima bounds their
overlap, and the sum over the upper corners of two boxes bounds it for all
points within. A Jaccard similarity of num/den or more needs an overlap of
num * (n + m) / (num + den) for sizes n and m, so boxes and points whose bound
is less are passed over; all numbers are whole. Neighbouring groups are added
up for a coarser bound first.

The tree is packed once (sort, tile, recurse): by size, then by the coordinate
that varies most, into leaves of LEAF points and nodes of FAN children.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Coordinates of a point, and of the coarser one that is looked at first.
GROUPS, COARSE = 256, 32
#: Largest count that a coordinate holds; only sets with more items can exceed it, and they have no bound by groups.
MOST = 65535
#: Points of a leaf, children of a node, cells (pairs times coordinates) of one step.
LEAF, FAN, STEP = 16, 8, 1 << 23


def count_vector(h: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many of the hashes fall into each group."""
    return np.minimum(np.bincount((h >> np.uint64(8)) % np.uint64(groups), minlength=groups), MOST).astype(np.uint16)


def overlap_bound(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most items that sets (or sets below nodes) of up to n and m items can share, row by row of their counts."""
    least = np.minimum(n, m).astype(np.int64)
    return np.where(least > MOST, least, np.minimum(least, np.minimum(a, b).sum(1, dtype=np.int64)))


def may_link(bound: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Can sets of at least n and m items whose overlap is at most `bound` be similar by num / den?"""
    return bound * (num + den) >= num * (n + m)


def packed_order(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Points by size in slabs, and in each slab by the coordinate that varies most."""
    order = np.argsort(size, kind="stable")
    slab = LEAF * max(1, int(np.sqrt(len(size) / LEAF)))
    for i in range(0, len(order), slab):
        own = order[i : i + slab]
        spread = points[own].var(0)
        order[i : i + slab] = own[np.argsort(points[own, spread.argmax()], kind="stable")]
    return order


class RTree:
    """points: counts by group, one row a set; size: items of each set; root, side: labels, see `pairs`."""

    def __init__(self, points: np.ndarray, size: np.ndarray, root: np.ndarray, side: np.ndarray | None = None):
        self.order = packed_order(points, size)
        side = np.zeros(len(size), np.int64) if side is None else side
        fine, low, roots, sides = points[self.order], size[self.order], root[self.order], side[self.order]
        coarse = fine.reshape(len(fine), COARSE, -1).sum(2, dtype=np.int64)
        # a level: upper corners, coarse and fine; least and largest size, root and side
        self.levels = [(coarse, fine, low, low, roots, roots, sides, sides)]
        while len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(self.levels[-1][0]), LEAF if len(self.levels) == 1 else FAN)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append(tuple(f(x, cut) for f, x in zip((most, most, least, most, least, most, least, most), self.levels[-1])))

    def _open(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int, across: bool) -> np.ndarray:
        """Which pairs of nodes of a level may hold a pair of linked points with different roots (and sides)."""
        coarse, fine, least, most, r0, r1, s0, s1 = self.levels[level]
        ok = (r0[i] != r1[j]) | (r1[i] != r0[j])
        if across:
            ok &= (s0[i] != s1[j]) | (s1[i] != s0[j])
        ok &= may_link(np.minimum(most[i], most[j]).astype(np.int64), least[i], least[j], num, den)
        for top in (coarse, fine):
            at = np.flatnonzero(ok)
            a, b = i[at], j[at]
            ok[at] = may_link(overlap_bound(top[a], top[b], most[a], most[b]), least[a], least[b], num, den)
        return ok

    def pairs(self, num: int, den: int, across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of points with different roots (across: and sides) whose overlap may suffice; each pair once."""
        zero = np.zeros(1, np.int64)
        todo = [(len(self.levels) - 1, zero, zero)] if len(self.order) > 1 else []
        step = max(1, STEP // self.levels[0][1].shape[1])
        while todo:
            level, i, j = todo.pop()
            if len(i) > step:
                todo.append((level, i[step:], j[step:]))
                i, j = i[:step], j[:step]
            ok = self._open(level, i, j, num, den, across)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            fan = LEAF if level == 1 else FAN
            n = len(self.levels[level - 1][0])
            for k in range(0, len(i), max(1, step // (fan * fan))):  # children of some pairs at a time
                a, b = i[k : k + max(1, step // (fan * fan))], j[k : k + max(1, step // (fan * fan))]
                x = (a[:, None, None] * fan + np.arange(fan)[:, None]).repeat(fan, 2).ravel()
                y = (b[:, None, None] * fan + np.arange(fan)[None, :]).repeat(fan, 1).ravel()
                ok = (x < n) & (y < n) & (x <= y if level > 1 else x < y)
                todo.append((level - 1, x[ok], y[ok]))
