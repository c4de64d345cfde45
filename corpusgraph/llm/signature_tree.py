"""A signature tree over sets of 64-bit hashes, and its dual traversal for pairs alike enough."""

from __future__ import annotations

import numpy as np

_FANOUT = 8
_LEAST_BITS, _MOST_BITS = 512, 1 << 16


class SignatureTree:
    """Levels of nodes from the leaves (one set each) to a single root.

    A node holds the OR of its sets' token bitmaps, their least and greatest size, and the most
    tokens that any of them has beyond its bits (tokens that share a bit with another).  Sets are
    put side by side by size and then by their smallest hashes, so that nodes stay tight.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets], np.int64)
        bits = _LEAST_BITS
        while bits < _MOST_BITS and bits < 64 * sizes.max(initial=1):
            bits *= 2
        steps = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25)).astype(np.int64)
        lows = np.array([int(x[0]) if len(x) else 0 for x in sets], np.uint64)
        self.order = np.lexsort((lows, steps))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            at = (sets[i] & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        sizes = sizes[self.order]
        beyond = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, beyond)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, beyond = self.levels[-1]
            starts = np.arange(0, len(maps), _FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, starts, axis=0),
                    np.minimum.reduceat(low, starts),
                    np.maximum.reduceat(high, starts),
                    np.maximum.reduceat(beyond, starts),
                )
            )

    def bound(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold a pair of sets with num / den of their union in common.

        Two sets share at most their common bits and the tokens that one of them has beyond its
        bits; node by node this is the common bits of the ORs and the smaller of the greatest
        excesses, and never more than the smaller of the greatest sizes.
        """
        maps, low, high, beyond = self.levels[level]
        most = np.empty(len(a), np.int64)
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            most[i : i + 4096] = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(most + np.minimum(beyond[a], beyond[b]), np.minimum(high[a], high[b]))
        # Of sizes s and t and overlap o, o / (s + t - o) is largest at the least s and t that hold o.
        s, t = np.maximum(low[a], most), np.maximum(low[b], most)
        union = s + t - most
        return den * most >= num * union


def linked(sets: list[np.ndarray], group: list[int], num: int = 80, den: int = 100) -> list[tuple[int, int]]:
    """Pairs of sets (sorted, distinct hashes) that link, as few as join what links join.

    *group* numbers what is joined already; pairs within it need no look, nor do pairs that links
    found so far have joined.  Leaves side by side are compared first, which joins most copies; then every other
    pair is ruled out by a bound of the tree, as are nodes of one and the same group, or compared.
    """
    if len(sets) < 2:
        return []
    tree = SignatureTree(sets)
    parent = {g: g for g in group}
    found: list[tuple[int, int]] = []

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(tree.order[a].tolist(), tree.order[b].tolist(), strict=True):
            x, y = root(group[i]), root(group[j])
            if x != y and alike(sets[i], sets[j], num, den):
                parent[y] = x
                found.append((i, j))

    beside = np.arange(len(sets) - 1)
    beside = beside[tree.bound(0, beside, beside + 1, num, den)]
    compare(beside, beside + 1)
    roots = np.array([root(group[i]) for i in tree.order])
    low, high = [roots], [roots]
    while len(low[-1]) > 1:
        starts = np.arange(0, len(low[-1]), _FANOUT)
        low.append(np.minimum.reduceat(low[-1], starts))
        high.append(np.maximum.reduceat(high[-1], starts))

    a = b = np.zeros(1, np.int64)
    for level in range(len(tree.levels) - 1, -1, -1):
        apart = (low[level][a] != high[level][b]) | (high[level][a] != low[level][b])
        a, b = a[apart], b[apart]
        fits = tree.bound(level, a, b, num, den)
        a, b = a[fits], b[fits]
        if level:
            n = len(tree.levels[level - 1][0])
            steps = np.arange(_FANOUT)
            x = np.repeat(a[:, None] * _FANOUT + steps, _FANOUT, axis=1).ravel()
            y = np.tile(b[:, None] * _FANOUT + steps, (1, _FANOUT)).ravel()
            kept = (x <= y) & (y < n) & (x < n)
            a, b = x[kept], y[kept]
    compare(a, b)
    return found


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if not len(x) or not len(y) or den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)
