"""Kd-trees over blocks of integer vectors, and the filtering step of Lloyd's method on them.

A tree is balanced: level d cuts the block, in the order of the tree, into 2 ** d ranges, so ranges need no
pointers. Every node keeps the box and the sum of its vectors; its count follows from its range. All
comparisons are in exact integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Vectors of a leaf, at most.
LEAF = 8
NEVER = np.iinfo(np.int64).max


def ranges(n: int, depth: int) -> np.ndarray:
    """Borders of the 2 ** depth ranges of n places."""
    return (np.arange((1 << depth) + 1, dtype=np.int64) * n) >> depth


@dataclass
class Tree:
    order: np.ndarray  # place of each vector in its block, in tree order
    points: np.ndarray  # vectors in tree order
    low: list[np.ndarray]  # by level, from the root
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def build(points: np.ndarray) -> Tree:
    """A tree over points, int64[n, width] with n > 0: each node is halved along the longest side of its box."""
    n, depth = len(points), 0
    while n > LEAF << depth:
        depth += 1
    order = np.arange(n)
    for level in range(depth):
        border = ranges(n, level)
        node = np.repeat(np.arange(1 << level), np.diff(border))
        inside = points[order]
        side = np.maximum.reduceat(inside, border[:-1]) - np.minimum.reduceat(inside, border[:-1])
        value = inside[np.arange(n), side.argmax(axis=1)[node]]
        order = order[np.lexsort((value, node))]
    inside = points[order]
    first = ranges(n, depth)[:-1]
    low, high, sums = [np.minimum.reduceat(inside, first)], [np.maximum.reduceat(inside, first)], [np.add.reduceat(inside, first)]
    for _ in range(depth):
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        sums.insert(0, sums[0][::2] + sums[0][1::2])
    return Tree(order, inside, low, high, sums)


def pruned(low: np.ndarray, high: np.ndarray, open_: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which of the open entries (bool[m, k]) can be the nearest of some place in each box (int64[m, width]).

    An entry goes if the one nearest to the middle of the box is as near at all corners: it suffices to look at
    the corner that lies furthest towards the entry. Ties go to the lower index, as in the assignment."""
    middle = (low + high) / 2
    about = ((middle[:, None, :] - entries) ** 2).sum(axis=2)
    best = np.where(open_, about, np.inf).argmin(axis=1)
    towards = entries[None, :, :] - entries[best][:, None, :]
    corner = (np.maximum(towards, 0) * high[:, None, :] + np.minimum(towards, 0) * low[:, None, :]).sum(axis=2)
    size = (entries**2).sum(axis=1)
    gain = size[best][:, None] - size[None, :] + 2 * corner  # distance to best less distance to the entry, at that corner
    index = np.arange(len(entries))
    stays = (gain > 0) | ((gain == 0) & (index[None, :] < best[:, None])) | (index[None, :] == best[:, None])
    return open_ & stays


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, int64[n, k]."""
    out = np.empty((len(points), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        out[:, k] = ((points - entry) ** 2).sum(axis=1)
    return out


@dataclass
class Found:
    count: np.ndarray  # vectors of each entry
    sums: np.ndarray  # their sums
    entry: np.ndarray  # of each vector, in tree order
    whole: int  # vectors that were assigned with their subtree


def assign(tree: Tree, entries: np.ndarray) -> Found:
    """The nearest entry of all vectors, lower indexes first: from the root down, boxes rule entries out, and a
    subtree with one entry left is assigned by its cached sum and count."""
    n, k = len(tree.points), len(entries)
    count, sums, entry, whole = np.zeros(k, np.int64), np.zeros_like(entries), np.zeros(n, np.int64), 0
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(tree.depth + 1):
        open_ = pruned(tree.low[level][nodes], tree.high[level][nodes], open_, entries)
        border = ranges(n, level)
        done = open_.sum(axis=1) == 1
        own = open_[done].argmax(axis=1)
        size = np.diff(border)[nodes[done]]
        np.add.at(count, own, size)
        np.add.at(sums, own, tree.sums[level][nodes[done]])
        whole += int(size.sum())
        for node, e in zip(nodes[done], own):
            entry[border[node] : border[node + 1]] = e
        nodes, open_ = nodes[~done], open_[~done]
        if level < tree.depth:
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            open_ = np.repeat(open_, 2, axis=0)
    sizes = np.diff(ranges(n, tree.depth))[nodes]
    if len(nodes):
        start = ranges(n, tree.depth)[nodes]
        at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        left = tree.points[at]
        far = np.where(np.repeat(open_, sizes, axis=0), distances(left, entries), NEVER)
        entry[at] = far.argmin(axis=1)
        np.add.at(count, entry[at], 1)
        np.add.at(sums, entry[at], left)
    return Found(count, sums, entry, whole)
