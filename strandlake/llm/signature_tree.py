"""Joins of sets by signature trees.

The sets of a group are sorted by size and bitmap and packed to a tree: a node holds the OR of its sets' bitmaps, the range of their
sizes, and the largest excess of a set's size over the bits of its bitmap. Two sets have at most as many members in common as bits of
both bitmaps and the smaller excess; for two nodes the same holds of what they store. The dual traversal begins with the pair of roots,
drops pairs of nodes that can't reach the needed overlap or whose sets are all in one component already, and ends with pairs of sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandlake.llm import shingles

#: Jaccard similarity as a ratio of integers: 100 * intersection >= 80 * union.
PART, WHOLE = 80, 100
FAN = 8
CHUNK = 1 << 15


def enough(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """WHOLE * common >= PART * (a + b - common)."""
    return (WHOLE + PART) * common >= PART * (a + b)


def common_members(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Components:
    """Labels of connected members: the least member's place."""

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.parent = np.arange(n)
        if labels is not None:  # members that are known to be connected
            _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = first[inverse]

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        p = self.parent
        while (q := p[p]).tolist() != p.tolist() if len(p) < 64 else not np.array_equal(q := p[p], p):
            p = q
        self.parent = p.copy()
        return p


class _Level:
    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray):
        self.bits, self.low, self.high, self.excess = bits, low, high, excess

    def above(self) -> _Level:
        at = np.arange(0, len(self.low), FAN)
        return _Level(np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.excess, at))


def _possible(x: _Level, i: np.ndarray, y: _Level, j: np.ndarray) -> np.ndarray:
    """Whether members of nodes i and j can reach the needed overlap."""
    fits = (WHOLE * x.high[i] >= PART * y.low[j]) & (WHOLE * y.high[j] >= PART * x.low[i])
    at = np.flatnonzero(fits)
    i, j = i[at], j[at]
    both = np.bitwise_count(x.bits[i] & y.bits[j]).sum(1, dtype=np.int64)
    most = np.minimum(both + np.minimum(x.excess[i], y.excess[j]), np.minimum(x.high[i], y.high[j]))
    fits[at] = enough(most, x.low[i], y.low[j])
    return fits


def _classes(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes <= 512, 0, np.where(sizes <= 2048, 1, 2))


def links(sizes: np.ndarray, bitmaps: list[np.ndarray], components: Components, linked: Callable[[int, int], bool] | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect the group: a spanning forest of all pairs that link, beyond what ``components`` knows already.

    ``linked`` decides on a pair of members (their places); without it, the bound of their bitmaps does. With ``side``, only pairs of a
    member with True and one with False are looked at.
    """
    out: list[tuple[int, int]] = []
    kind = _classes(sizes)
    for k in range(3):
        a = np.flatnonzero(kind == k)
        if not len(a):
            continue
        own = np.stack([bitmaps[m] for m in a])
        words = own.shape[1]
        _dual(a, own, a, own, sizes, components, linked, side, out, True)
        if k < 2 and len(b := np.flatnonzero(kind == k + 1)):
            _dual(a, own, b, shingles.fold(np.stack([bitmaps[m] for m in b]), words), sizes, components, linked, side, out, False)
    if (kind == 0).any() and (kind == 2).any():  # sizes 512 and 2049 are too far apart to link
        pass
    return out


def _tree(members: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[_Level]]:
    order = np.lexsort((*(bits[:, c] for c in range(min(4, bits.shape[1]))), sizes[members]))
    members, bits = members[order], bits[order]
    size = sizes[members].astype(np.int64)
    levels = [_Level(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64))]
    while len(levels[-1].low) > FAN:
        levels.append(levels[-1].above())
    return members, levels


def _dual(a, own, b, other, sizes, components, linked, side, out, same: bool) -> None:
    ma, ta = _tree(a, own, sizes)
    mb, tb = (ma, ta) if same else _tree(b, other, sizes)
    while len(tb) < len(ta):
        tb = [*tb, tb[-1].above()]
    while len(ta) < len(tb):
        ta = [*ta, ta[-1].above()]

    def accept(i: np.ndarray, j: np.ndarray) -> None:
        """Takes pairs of members one for each two components at a time, as long as there are any."""
        while True:
            label = components.labels()
            x, y = label[i], label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                return
            key = np.minimum(x, y) * len(label) + np.maximum(x, y)
            _, first = np.unique(key, return_index=True)
            for p, q in zip(i[first].tolist(), j[first].tolist()):
                if components.find(p) != components.find(q) and (linked is None or linked(p, q)):
                    components.union(p, q)
                    out.append((p, q))
            left = np.ones(len(i), bool)
            left[first] = False
            i, j = i[left], j[left]

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        keep = i < j if same else np.ones(len(i), bool)
        if side is not None:
            keep &= side[ma[i]] != side[mb[j]]
        i, j = i[keep], j[keep]
        label = components.labels()
        apart = label[ma[i]] != label[mb[j]]
        i, j = i[apart], j[apart]
        fits = _possible(ta[0], i, tb[0], j)
        accept(ma[i[fits]], mb[j[fits]])

    if same and len(ma) > FAN:  # neighbours first: a large group of copies is then one component before pairs of nodes are met
        for gap in range(1, 4):
            pairs(np.arange(len(ma) - gap), np.arange(gap, len(ma)))

    def uniform(members: np.ndarray, level: int) -> np.ndarray:
        """The label of each node whose members have one, else -1."""
        label, step = components.labels()[members], FAN**level
        at = np.arange(0, len(members), step)
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        return np.where(low == high, low, -1)

    top = len(ta) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(ta[top].low)), np.arange(len(tb[top].low)), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if same:
            ordered = i <= j
            i, j = i[ordered], j[ordered]
        if not level:
            pairs(i, j)
            continue
        ua, ub = uniform(ma, level), uniform(mb, level)
        apart = (ua[i] < 0) | (ua[i] != ub[j])
        i, j = i[apart], j[apart]
        fits = _possible(ta[level], i, tb[level], j)
        i, j = i[fits], j[fits]
        na, nb = len(ta[level - 1].low), len(tb[level - 1].low)
        for s in range(0, len(i), max(1, CHUNK // FAN**2)):
            x, y = i[s : s + CHUNK // FAN**2], j[s : s + CHUNK // FAN**2]
            x = (x[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
            y = (y[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            inside = (x < na) & (y < nb)
            stack.append((level - 1, x[inside], y[inside]))
