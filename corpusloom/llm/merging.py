"""Byte-pair merging of many short sequences at once, on ragged numpy arrays.

In every round each sequence applies the pair of lowest rank that it holds. All its non-overlapping
places are merged together where that gives the same result as one at a time from the left: no pair
that the merged symbol can be part of may have the same or a lower rank. Otherwise only the leftmost
place is merged. Sequences longer than LONG symbols go through a heap, so that the work stays
near-linear in their length.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
LONG = 1024


class PairMerger:
    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        """Pairs of non-negative symbols, their ranks (lower first) and the symbols they become."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], rank[order].astype(np.int32), merged[order].astype(np.int32)
        top = int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1
        lowest = np.full(top, NONE, np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.together = (lowest[self.merged] > self.rank) if len(key) else np.zeros(0, bool)
        # one rank may stand for pairs with different results: these go one at a time
        many = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
        first = np.full(len(many), -1, np.int64)
        first[self.rank] = self.merged
        np.add.at(many, self.rank, (first[self.rank] != self.merged).astype(np.int64))
        self.together &= many[self.rank] == 0

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of the pairs in the table, -1 for those it lacks."""
        want = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        return np.where((left >= 0) & (right >= 0) & (self.key[at] == want), at, -1) if len(self.key) else np.full(len(want), -1)

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of symbols (negative: never merges), flat, and their sizes; both after merging."""
        symbols, sizes = symbols.astype(np.int64), sizes.astype(np.int64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = len(sizes)
        number = np.arange(count)
        if (sizes > LONG).any():
            end = np.cumsum(sizes)
            for k in np.flatnonzero(sizes > LONG):
                out = self.by_heap(symbols[end[k] - sizes[k] : end[k]].tolist())
                kept.append((np.array([k]), np.array([len(out)]), np.array(out, np.int64)))
            short = sizes <= LONG
            symbols, number, sizes = symbols[np.repeat(short, sizes)], number[short], sizes[short]
        some = sizes > 0
        number, sizes = number[some], sizes[some]
        place = self.places(symbols, sizes)
        while len(sizes):
            start = np.cumsum(sizes) - sizes
            rank = np.where(place >= 0, self.rank[place] if len(self.rank) else NONE, NONE)
            least = np.minimum.reduceat(rank, start)
            live = least < NONE
            if not live.all():
                over = np.repeat(~live, sizes)
                kept.append((number[~live], sizes[~live], symbols[over]))
                symbols, place, rank = symbols[~over], place[~over], rank[~over]
                number, sizes, least = number[live], sizes[live], least[live]
                if not len(sizes):
                    break
            sequence = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == least[sequence])
            new = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = np.flatnonzero(new)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            leftmost = np.concatenate([[True], sequence[at[1:]] != sequence[at[:-1]]])
            at = at[np.where(self.together[place[at]], nth % 2 == 0, leftmost)]
            symbols[at] = self.merged[place[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            sizes = sizes - np.bincount(sequence[at], minlength=len(sizes))
            moved = np.cumsum(stay) - 1
            changed = moved[at]
            symbols, place, sequence = symbols[stay], place[stay], sequence[stay]
            look = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            following = np.minimum(look + 1, len(symbols) - 1)
            found = self.find(symbols[look], symbols[following])
            place[look] = np.where((look + 1 < len(symbols)) & (sequence[look] == sequence[following]), found, -1)
        out = np.zeros(count, np.int64)
        if not kept:
            return np.zeros(0, np.int64), out
        numbers, lengths, flat = (np.concatenate(x) for x in zip(*kept))
        out[numbers] = lengths
        begin = np.zeros(count, np.int64)
        begin[numbers] = np.cumsum(lengths) - lengths
        before = np.cumsum(out) - out
        return flat[np.arange(len(flat)) + np.repeat(begin - before, out)], out

    def places(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each symbol the place in the table of the pair that it begins."""
        place = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            place[:-1] = self.find(symbols[:-1], symbols[1:])
            place[np.cumsum(sizes)[:-1] - 1] = -1
        return place

    def by_heap(self, symbols: list[int]) -> list[int]:
        """One sequence, a pair at a time, the leftmost first among equal ranks."""
        n = len(symbols)
        after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
        first = self.find(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(self.rank[p]), i, symbols[i], symbols[i + 1], int(self.merged[p])) for i, p in enumerate(first.tolist()) if p >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int] | None] = {}
        gone = [False] * n

        def push(i: int, j: int) -> None:
            pair = (symbols[i], symbols[j])
            if pair not in known:
                p = int(self.find(np.array([pair[0]]), np.array([pair[1]]))[0])
                known[pair] = (int(self.rank[p]), int(self.merged[p])) if p >= 0 else None
            if known[pair]:
                heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = c, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s, g in zip(symbols, gone) if not g]
