"""Signature trees: exact set similarity joins of token sets held in memory.

A node has the OR of its members' token bitmaps, the range of their sizes and the largest
surplus (tokens of a member beyond its set bits). Two trees are traversed together; a pair
of nodes is left where sizes are too far apart, or where the bits both have, plus the
surplus, can't make up the overlap that the threshold asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

FANOUT = 8


class Forest:
    """Union-find over places; the least place is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Node:
    __slots__ = ("bits", "low", "high", "surplus", "children", "members", "uniform")

    def __init__(self, bits, low, high, surplus, children=(), members=()):
        self.bits, self.low, self.high, self.surplus = bits, low, high, surplus
        self.children, self.members, self.uniform = children, members, len(members) == 1


def _bitmap(tokens: np.ndarray, width: int) -> int:
    flags = np.zeros(width, np.uint8)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


def build(sets: Sequence[np.ndarray], places: Sequence[int], width: int) -> Node:
    """The tree over the members at `places`; similar members stand close together."""
    order = sorted(places, key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i]), i))
    level = []
    for i in order:
        bits = _bitmap(sets[i], width)
        level.append(Node(bits, len(sets[i]), len(sets[i]), len(sets[i]) - bits.bit_count(), members=(i,)))
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FANOUT):
            part = level[k : k + FANOUT]
            bits = 0
            for x in part:
                bits |= x.bits
            up.append(Node(bits, min(x.low for x in part), max(x.high for x in part), max(x.surplus for x in part), part, [m for x in part for m in x.members]))
        level = up
    return level[0]


def apart(a: Node, b: Node, percent: int) -> bool:
    """No member of a can reach percent / 100 with one of b."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return True
    most = min((a.bits & b.bits).bit_count() + min(a.surplus, b.surplus), a.high, b.high)
    return most * (100 + percent) < percent * (a.low + b.low)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly; sorted sets without repeats."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def join(sets: Sequence[np.ndarray], percent: int, left: Sequence[int] | None = None, right: Sequence[int] | None = None, every: bool = False):
    """Links (i, j, i < j) that connect whatever similar pairs connect, or every similar pair.

    All pairs of `sets` are covered, or those of a place in `left` with one in `right`.
    Unless every pair is asked for, one already connected by the links so far isn't compared,
    so copies of one text cost about as much as their number. Sets must not be empty.
    """
    n = len(sets)
    if n < 2:
        return []
    width = 256
    while width < 2 * max(map(len, sets)):
        width *= 2
    forest, links = Forest(n), []

    def same(node: Node) -> bool:
        if not node.uniform:
            root = forest.find(node.members[0])
            node.uniform = all(forest.find(m) == root for m in node.members)
        return node.uniform

    def pair(a: Node, b: Node):
        if not every and same(a) and same(b) and forest.find(a.members[0]) == forest.find(b.members[0]) or apart(a, b, percent):
            return
        if not a.children and not b.children:
            i, j = a.members[0], b.members[0]
            if similar(sets[i], sets[j], percent) and (forest.union(i, j) or every):
                links.append((min(i, j), max(i, j)))
        elif a.children and (not b.children or len(a.members) >= len(b.members)):
            for c in a.children:
                pair(c, b)
        else:
            for c in b.children:
                pair(a, c)

    def inside(a: Node):
        for c in a.children:
            inside(c)
        for k, c in enumerate(a.children):
            for d in a.children[k + 1 :]:
                pair(c, d)

    if left is None:
        inside(build(sets, range(n), width))
    elif len(left) and len(right):
        pair(build(sets, left, width), build(sets, right, width))
    return links
