"""A tree over token bitmaps that finds pairs of sets which may overlap enough.

A set is summarised by its size and a bitmap with about one bit for each element, or a few (a
power of two; wider ones fold onto narrower ones). A node holds the OR of the bitmaps below it, the range
of their sizes, and the largest number of elements that share a bit with another element of
their set. Two sets under two nodes can't overlap by more than the common bits of the nodes plus
the smaller of these two numbers, nor can sets whose sizes differ too much; such pairs of nodes
are pruned with all that is below them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FAN = 8
_NARROW, _WIDE = 64, 1 << 17


def width(n: int) -> int:
    return min(max(1 << (max(n, 1) - 1).bit_length(), _NARROW), _WIDE)


def bitmap(elements: np.ndarray, per: int = 1) -> np.ndarray:
    """At least ``per`` bits for each element, up to the widest."""
    w = width(len(elements) * per)
    bits = np.zeros(w, bool)
    bits[(elements & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


class Threshold:
    """Jaccard similarity of at least ``of`` hundredths, in whole numbers."""

    def __init__(self, of: int):
        self.of = of

    def overlap(self, a: int, b: int) -> int:
        """Least overlap of sets of these sizes that are similar enough."""
        return -(-self.of * (a + b) // (100 + self.of))

    def sizes(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.of * max(a, b)

    def prefix(self, n: int) -> int:
        """Of the n elements of a set in any fixed order, so many first ones hold one of every
        similar set's."""
        return n + (self.of * n // -100) + 1 if n else 0


class Node:
    __slots__ = ("bits", "count", "excess", "below", "high", "low")

    def __init__(self, below: list, bits: np.ndarray, low: int, high: int, excess: int):
        self.below, self.bits, self.low, self.high, self.excess = below, bits, low, high, excess


def _leaf(i: int, n: int, bits: np.ndarray, size: int) -> Node:
    bits = fold(bits, size)
    return Node([i], bits, n, n, n - ones(bits))


def build(members: list[int], sizes: list[int], bitmaps: list[np.ndarray]) -> Node:
    """A tree over the members in order of size; leaves are single sets."""
    order = sorted(members, key=lambda i: sizes[i])
    level = [_leaf(i, sizes[i], bitmaps[i], len(bitmaps[i])) for i in order]
    while len(level) > 1:
        level = [_join(level[k : k + FAN], sizes, bitmaps) for k in range(0, len(level), FAN)]
    return level[0]


def _excess(node: Node, folded: np.ndarray) -> int:
    """Bound on the elements of a set under ``node`` that share a bit of the folded bitmap."""
    if len(node.bits) == len(folded):
        return node.excess
    return node.high - ones(folded) if isinstance(node.below[0], int) else node.high - 1


def _join(nodes: list[Node], sizes: list[int], bitmaps: list[np.ndarray]) -> Node:
    if len(nodes) == 1:
        return nodes[0]
    size = min(len(x.bits) for x in nodes)
    folded = [fold(x.bits, size) for x in nodes]
    # folding makes more elements share a bit
    excess = max(_excess(x, f) for x, f in zip(nodes, folded))
    return Node(nodes, np.bitwise_or.reduce(folded), min(x.low for x in nodes), max(x.high for x in nodes), excess)


def may_overlap(a: Node, b: Node, least: Threshold) -> bool:
    if a.high < b.low:
        a, b = b, a
    if b.high < a.low and not least.sizes(b.high, a.low):
        return False
    size = min(len(a.bits), len(b.bits))
    x, y = fold(a.bits, size), fold(b.bits, size)
    return ones(x & y) + min(_excess(a, x), _excess(b, y)) >= least.overlap(a.low, b.low)


def traverse(a: Node, b: Node, least: Threshold, visit: Callable[[int, int], None], skip: Callable[[int, int], bool]) -> None:
    """Call ``visit`` for each pair (of a set under ``a`` and one under ``b``, or of two under
    the same node) that no bound excludes and ``skip`` doesn't."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        leaves = isinstance(a.below[0], int), isinstance(b.below[0], int)
        if a is b:
            if not leaves[0]:
                own = a.below
                stack += [(own[i], own[j]) for i in range(len(own)) for j in range(i, len(own))]
            continue
        if all(leaves) and skip(a.below[0], b.below[0]):
            continue
        if not may_overlap(a, b, least):
            continue
        if all(leaves):
            visit(a.below[0], b.below[0])
        elif leaves[1] or (not leaves[0] and a.high - a.low >= b.high - b.low):
            stack += [(x, b) for x in a.below]
        else:
            stack += [(a, x) for x in b.below]
