"""Fingerprints within a few bits of each other, and connected components.

``close`` searches two lists of 64-bit fingerprints in Gray order through a tree: eight
neighbours make a node that keeps the bits all of them share, so two nodes differ by at least
the shared bits in which they disagree. Pairs of nodes beyond the distance are pruned whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.tables import written
from veilscan.session import ship_by_value

ship_by_value(__name__)

FAN = 8
PAIRS_AT_ONCE = 1 << 14


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in Gray-code order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def gray_rank_column(x: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


class Forest:
    """Disjoint sets over 0..n-1 as a flat array of smallest members."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                deeper = self.of[self.of]
                if np.array_equal(deeper, self.of):
                    break
                self.of = deeper


def tree(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up; each has (bits set in all, bits clear in all) of its nodes."""
    levels = [(values, ~values)]
    while len(levels[-1][0]) > FAN:
        ones, zeros = levels[-1]
        cuts = np.arange(0, len(ones), FAN)
        levels.append((np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)))
    return levels


def close(
    a: np.ndarray, b: np.ndarray | None, bits: int, found: Callable[[np.ndarray, np.ndarray], None],
    skip: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> None:
    """Calls ``found`` with index arrays of all pairs within ``bits``; ``b`` None: pairs i < j
    inside ``a``. ``skip`` may rule out pairs just before they are compared."""
    own = b is None
    left, right = tree(a), tree(a if own else b)
    while len(left) < len(right):
        left.append((np.bitwise_and.reduce(left[-1][0], keepdims=True), np.bitwise_and.reduce(left[-1][1], keepdims=True)))
    while len(right) < len(left):
        right.append((np.bitwise_and.reduce(right[-1][0], keepdims=True), np.bitwise_and.reduce(right[-1][1], keepdims=True)))
    top = len(left) - 1
    i, j = np.meshgrid(np.arange(len(left[top][0])), np.arange(len(right[top][0])), indexing="ij")
    todo = [(top, i.ravel(), j.ravel())]
    step = np.arange(FAN)
    while todo:
        level, i, j = todo.pop()
        if len(i) > PAIRS_AT_ONCE:
            todo.extend((level, i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE])
                        for k in range(0, len(i), PAIRS_AT_ONCE))
            continue
        keep = i <= j if own and level else i < j if own else np.ones(len(i), bool)
        if level == 0 and skip is not None:
            keep &= ~skip(i, j)
        i, j = i[keep], j[keep]
        (ones, zeros), (others, nothers) = left[level], right[level]
        apart = np.bitwise_count((ones[i] & nothers[j]) | (zeros[i] & others[j]))
        i, j = i[apart <= bits], j[apart <= bits]
        if not len(i):
            continue
        if level == 0:
            found(i, j)
            continue
        n, m = len(left[level - 1][0]), len(right[level - 1][0])
        x, y = np.broadcast_arrays((i[:, None] * FAN + step)[:, :, None], (j[:, None] * FAN + step)[:, None, :])
        x, y = x.ravel(), y.ravel()
        good = (x < n) & (y < m)
        todo.append((level - 1, x[good], y[good]))


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges(a, b)``.

    Large-star and small-star steps in turn: each links neighbours to the smallest id around, so
    hubs shrink and paths halve. Every step is joins and grouped minima over an edge table that
    is written and read again.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, name)
    state = None
    while True:
        size = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == state or not size[0]:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                pairs.select(F.col("v"), F.col("v")).distinct()
            )
        state = size
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
